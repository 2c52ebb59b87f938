"""Secret scans with a randomness battery, native.

Three fixed patterns find the base spans. The method adds spans of kind ``random``: long tokens are
read in the encoding that their characters allow (runs that fit none are read in parts), and pass if
(1) none of the tests of a chi-squared statistic of the alphabet, of runs above and below its middle, and of serial
correlation rejects uniform randomness at BATTERY / 3, and
(2) the likelihood ratio of uniform characters to a model of written words is large. Under the word model its
inverse is a valid p-value, which falls with the token's length. A token that fails (1) has p-value 1: so (1) and (2) are one
p-value, valid as it is never below that of (2), and over all tokens of a length band the Benjamini-Hochberg
rule holds the rate of false discoveries at FDR. Its threshold is read from a histogram of p-values in a
fixed number of bins, whose upper edges count, so it is never too high.

Defined cases: a null text counts as empty; a null id is an id like others; repeated rows have equal results; spans that overlap a base
span aren't added; an empty table gives an empty result; further columns pass through scan(), whose own columns
replace others of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import or_empty, table, written

# The base patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

# an equals sign is padding if no further character of a token follows; else it ends one token and another may begin
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?"
# Alphabets by encoding, the first that holds a token is taken
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", DIGITS + "abcdef"),
    "hex_upper": ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    "base32": ("^[A-Z2-7]+=*$", UPPER + "234567"),
    "base36": ("^[a-z0-9]+$", DIGITS + LOWER),
    "base36_upper": ("^[A-Z0-9]+$", DIGITS + UPPER),
    "base62": ("^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    "base64": ("^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    "base64_url": ("^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
}
# Per mille of each letter a to z in written text, averaged over western European languages
LETTERS = (82, 13, 31, 45, 142, 12, 16, 25, 73, 3, 5, 44, 27, 76, 65, 24, 6, 66, 70, 71, 37, 12, 11, 3, 12, 9)
LOWER_SHARE, UPPER_SHARE, DIGIT_SHARE, OTHER_SHARE = 0.85, 0.05, 0.04, 0.06
BATTERY, FDR = 0.001, 0.01
#: Length bands by their shortest length, and bins of a tenth of -log10 p.
BANDS = (20, 28, 36, 44, 64, 96)
BINS = 400


def located(text: Column, pattern: str, possible: Column) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches, in code points: what lies between matches gives
    their places. possible: a cheap condition that every text with a match meets."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("out"))

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(possible & text.rlike(pattern), F.aggregate(F.filter(pairs, lambda x: x["match"].isNotNull()), start, step)["out"]).otherwise(none)


def normal_tail(z: Column) -> Column:
    """P(Z > z) by a rational approximation (error under 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    upper = 0.3989422804014327 * F.exp(-z * z / 2) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, upper).otherwise(1 - upper)


def parted(tokens: Column) -> Column:
    """tokens (start, end, match), those that fit no encoding replaced by their long parts between slashes, and what fits none then by its long parts between plus signs."""
    fits = lambda x: x["match"].rlike("|".join(f"(?:{pattern})" for pattern, _ in ENCODINGS.values()))

    def parts(pattern: str):
        moved = lambda x: F.transform(located(x["match"], pattern, F.lit(True)), lambda y: F.struct((x["start"] + y["start"]).alias("start"), (x["start"] + y["end"]).alias("end"), y["match"].alias("match")))
        return lambda x: F.when(fits(x), F.array(x)).otherwise(moved(x))

    for sign in "/+":
        tokens = F.flatten(F.transform(tokens, parts(rf"[^{sign}]{{{BANDS[0]},}}")))
    return tokens


def battery(tokens: Column) -> Column:
    """tokens (start, end, match) with p_random, the smallest p-value of the three tests against uniform randomness, and
    evidence, log10 of the likelihood ratio of uniform characters to written words. Built in steps whose fields later ones reuse."""
    total = float(sum(LETTERS))
    shares = [LOWER_SHARE * x / total for x in LETTERS] + [UPPER_SHARE * x / total for x in LETTERS] + [DIGIT_SHARE / 10] * 10 + [OTHER_SHARE / 5] * 5
    order = F.lit(LOWER + UPPER + DIGITS + "+/_=-")

    def add(old: tuple[str, ...], new):
        return lambda x: F.struct(*[x[k].alias(k) for k in old], *[v.alias(k) for k, v in new(x).items()])

    def encoded(x: Column) -> dict[str, Column]:
        alphabet = F.lit("")
        for pattern, letters in reversed(ENCODINGS.values()):
            alphabet = F.when(x["match"].rlike(pattern), F.lit(letters)).otherwise(alphabet)
        return {"alphabet": alphabet, "chars": F.filter(F.split(F.rtrim(x["match"], F.lit("=")), ""), lambda c: c != "")}

    def placed(x: Column) -> dict[str, Column]:
        letters = x["alphabet"]
        return {"k": F.length(letters).cast("double"), "n": F.size(x["chars"]).cast("double"), "values": F.transform(x["chars"], lambda c: F.instr(letters, c).cast("double") - 1), "words": F.aggregate(x["chars"], F.lit(0.0), lambda a, c: a + F.log10(F.get(F.lit(shares), F.instr(order, c) - 1)))}

    def summed(x: Column) -> dict[str, Column]:
        v, k = x["values"], x["k"]
        held = F.transform(F.array_distinct(v), lambda d: F.size(F.filter(v, lambda y: y == d)).cast("double"))
        rest = F.greatest(F.size(v) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(v, 1, rest), F.slice(v, 2, rest), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return {"squares": F.aggregate(held, F.lit(0.0), lambda a, y: a + y * y), "ups": F.size(F.filter(v, lambda y: y >= k / 2)).cast("double"), "pairs": pairs, "middle": F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / x["n"]}

    def tested(x: Column) -> dict[str, Column]:
        n, k, ups, m = x["n"], x["k"], x["ups"], x["middle"]
        chi = k / n * x["squares"] - n
        # Wilson and Hilferty's cube root, on a chi-squared variable with the statistic's own mean and variance
        df = (k - 1) * n / (n - 1)
        p_chi = normal_tail((F.cbrt(F.greatest(chi, F.lit(0.0)) / (k - 1)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        runs = 1.0 + F.size(F.filter(x["pairs"], lambda y: (y["a"] >= k / 2) != (y["b"] >= k / 2)))
        expected = 2 * ups * (n - ups) / n + 1
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        energy = F.aggregate(x["values"], F.lit(0.0), lambda a, y: a + (y - m) * (y - m))
        lagged = F.aggregate(x["pairs"], F.lit(0.0), lambda a, y: a + (y["a"] - m) * (y["b"] - m))
        return {"p_chi": p_chi, "p_runs": 2 * normal_tail(F.abs(runs - expected) / spread), "p_serial": F.when(energy > 0, 2 * normal_tail(F.abs(lagged / energy + 1 / n) * F.sqrt(n))).otherwise(0.0)}

    def judged(x: Column) -> Column:
        usable = (x["alphabet"] != "") & (x["n"] >= BANDS[0]) & ~x["match"].rlike("^[0-9]+=*$")
        p, evidence = F.least(x["p_chi"], x["p_runs"], x["p_serial"]), -x["n"] * F.log10(x["k"]) - x["words"]
        size = x["end"] - x["start"]
        band = sum((F.when(size >= low, 1).otherwise(0) for low in BANDS[1:]), F.lit(0))
        level = F.least(F.greatest(F.floor(evidence * 10), F.lit(0)), F.lit(BINS)).cast("int")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), band.alias("band"), F.when(usable, p).otherwise(0.0).alias("p_random"), F.when(usable & (p >= BATTERY / 3), level).otherwise(0).alias("bin"))

    keep = ("start", "end", "match", "alphabet")
    tokens = F.transform(tokens, add(keep[:3], encoded))
    tokens = F.transform(tokens, add((*keep, "chars"), placed))
    # tokens of no known encoding or too short are not tested, but count as hypotheses
    tokens = F.transform(tokens, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "match", "alphabet", "words", "values")], F.greatest(x["k"], F.lit(2.0)).alias("k"), F.greatest(x["n"], F.lit(2.0)).alias("n")))
    tokens = F.transform(tokens, add((*keep, "words", "values", "k", "n"), summed))
    tokens = F.transform(tokens, add((*keep, "words", "k", "n"), lambda x: tested(x)))
    return F.transform(tokens, judged)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with base, the spans of the fixed patterns, and tokens, the long tokens with band, battery p-value and evidence."""
    t = or_empty(text)
    # what HEX and ACCESS match lies in a run that TOKEN matches
    df = df.withColumn("__long", t.rlike(TOKEN))
    assigned = F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))
    assign = F.filter(located(t, ASSIGN, assigned), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 6)
    out = df.withColumns({"__assign": assign, "__access": located(t, ACCESS, F.col("__long")), "__hex": located(t, HEX, F.col("__long")), "__tokens": located(t, TOKEN, F.col("__long"))})
    span = lambda kind: lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"))
    out = out.withColumn("base", F.concat(*[F.transform(f"__{kind}", span(kind)) for kind in KINDS[:3]]))
    free = F.filter(parted(F.col("__tokens")), lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])))

    out = out.withColumn("__free", free).withColumn("tokens", battery(F.col("__free")))
    return out.drop("__assign", "__access", "__hex", "__tokens", "__free", "__long")


def thresholds(measured: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """For each length band the lowest bin of evidence whose discoveries the Benjamini-Hochberg rule admits. From at most BANDS * (BINS + 1) rows."""
    counts = measured.select(F.explode("tokens").alias("t")).groupBy("t.band", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("band").orderBy(F.desc("bin"))
    counts = counts.withColumns({"found": F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)), "m": F.sum("n").over(Window.partitionBy("band"))})
    admitted = counts.where((F.col("bin") > 0) & (F.pow(F.lit(10.0), -F.col("bin") / 10) <= fdr * F.col("found") / F.col("m")))
    return {r["band"]: r["bin"] for r in admitted.groupBy("band").agg(F.min("bin").alias("bin")).collect()}


def scan(measured: DataFrame, least: dict[int, int]) -> DataFrame:
    """measured with spans: the base spans and the added ones as (start, kind number, end), in order."""
    needed = F.create_map(*[F.lit(x) for band in range(len(BANDS)) for x in (band, least.get(band, BINS + 1))])
    more = F.filter("tokens", lambda x: x["bin"] >= needed[x["band"]])
    more = F.transform(more, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return measured.withColumn("spans", F.array_sort(F.concat("base", more)))


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The texts with every span, overlapping ones merged, replaced by a mark."""
    t = or_empty(text)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        inside = x["start"] < a["at"]
        gap = F.substring(t, a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], F.when(inside, F.lit("")).otherwise(F.concat(gap, F.lit(mark)))).alias("out"))

    done = F.aggregate("spans", state, step)
    return scanned.withColumn("__done", done).withColumn(text, F.concat(F.col("__done.out"), F.substring(t, F.col("__done.at") + 1, F.length(t)))).drop("__done")


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = written(measure(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "secrets")
    found = scan(measured, thresholds(measured))
    # a second parameter of the lambda, even one with a default, would be the element's place
    of_kind = lambda i: F.filter("base", lambda x: x["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(listed(F.array_sort("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
