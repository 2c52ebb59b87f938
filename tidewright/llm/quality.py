"""Quality rules with risk-controlled thresholds, native.

Each rule turns one ratio of a document into a level on a fixed grid; a document is rejected
if its level reaches the cutoff of its stratum. Cutoffs come from labelled documents. The rules of a stratum are tested together,
by what they reject jointly, so they don't share the allowed rate or the error level: a path of cutoffs is laid out from
the bad labelled documents and one in LEARN of the good ones, drawn by a hash of the id; it takes rule after rule, the one that gains
most first, and lowers its cutoff level by level. The other good documents certify it: as long as the exact binomial
probability of so few false rejections by all cutoffs so far, were their true rate the allowed one, stays within the error level
(fixed-sequence testing: the path doesn't depend on the documents that test it, so the walk needs no correction; strata share
the error level by Bonferroni). Of the certified points of the path the one that rejects most bad and fewest good labelled
documents is taken; if none is certified, no rule rejects there.

Defined cases: a null text has no words; a null id has no label; a null or unlisted language is in the stratum "other"; a
document labelled twice counts as good if any of its labels is; labels that are null or of
no document take no part; without labels only the base rule holds; repeated rows get the same verdict; an empty
table gives an empty result; further columns pass through, and those added here replace others
of the same name.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import or_empty, table, words, written

WINDOW = 8
#: Strata are these languages and "other", which bounds the table of cutoffs.
STRATA = ("en", "de", "fr", "es")
#: Largest true rate of false rejections in a stratum by all rules together, and the probability that the certified cutoffs of any stratum break it.
ALLOWED, ERROR = 0.02, 0.05
LEVELS = 64
#: A rejected good document weighs as much as so many rejected bad ones when a certified cutoff is picked.
PRICE = 10
#: One in so many good labelled documents helps to lay out the path and doesn't test it.
LEARN = 5
#: Rule, its ratio, and the ratio of the highest level.
RULES = ("symbols", "upper", "marks", "lines", "repeats", "long_words")


def _with_window_hashes(df: DataFrame, array: str) -> DataFrame:
    """df with __hashes, a hash of every window of WINDOW words, by doubling: of words, of two neighbours, of two pairs, of two fours. Null if there are fewer than two windows."""
    df = df.withColumn("__hashes", F.when(F.size(array) > WINDOW, F.transform(array, lambda x: F.xxhash64(x))))
    width = 1
    while width < WINDOW:
        n, h = F.size("__hashes") - width, F.col("__hashes")
        df = df.withColumn("__hashes", F.zip_with(F.slice(h, 1, n), F.slice(h, width + 1, n), lambda a, b: F.xxhash64(a, b)))
        width *= 2
    return df


def base(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts of the base rule and those that further rules need."""
    t = or_empty(text)
    count = lambda chars: F.regexp_count(t, F.lit(f"[{chars}]"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"__words": words(t), "__lines": lines, "n_symbols": count("#*$%&|<>").cast("long"), "__upper": count("A-Z"), "__marks": count("!?")})
    n = F.size("__words")
    df = df.withColumns({"n_words": n.cast("long"), "word_chars": F.length(F.array_join("__words", "")).cast("long"), "__n_lines": F.size("__lines"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")})
    df = _with_window_hashes(df, "__words").drop("__words", "__lines").withColumn("__twice", F.size(F.array_distinct("__hashes")) < F.size("__hashes"))
    order = F.when(F.col("__twice"), F.array_sort(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("__order", order).drop("__hashes")
    hash_at = lambda i: F.get(F.col("__order"), i)["h"]
    shared = F.filter("__order", lambda x, i: (F.coalesce(hash_at(i + 1) == x["h"], F.lit(False))) | ((i > 0) & (hash_at(F.greatest(i - 1, F.lit(0))) == x["h"])))
    starts = F.array_sort(F.transform(shared, lambda x: x["i"]))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).cast("long").alias("n")))["n"]
    df = df.withColumn("n_repeat_words", F.when(F.col("__twice"), covered).otherwise(F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__twice", "__order")


def levels(df: DataFrame, lang: str = "lang") -> DataFrame:
    """df with the stratum and one level from 0 to LEVELS for each rule."""
    per = lambda x, y, top: F.least(F.floor(F.col(x) / F.greatest(F.col(y), F.lit(1)) * (LEVELS / top)), F.lit(LEVELS)).cast("int")
    stratum = F.when(F.col(lang).isin(*STRATA), F.col(lang)).otherwise("other")
    df = df.withColumns({"stratum": stratum, "l_symbols": per("n_symbols", "n_words", 2), "l_upper": per("__upper", "word_chars", 1), "l_marks": per("__marks", "n_words", 2), "l_lines": per("n_dup_lines", "__n_lines", 1), "l_repeats": per("n_repeat_words", "n_words", 1), "l_long_words": per("word_chars", "n_words", 32)})
    return df.drop("__upper", "__marks", "__n_lines")


def log_gamma(x: Column) -> Column:
    """Stirling's series, moved up by 10 so that it holds from 1 on (error under 1e-12)."""
    y = x + 10
    up = F.ln(x)
    for i in range(1, 10):
        up = up + F.ln(x + i)
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - up


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact but for rounding: the terms from k downwards, as far as they can count; 1 at or above the mean."""
    top = log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + k * log(p) + (n - k) * log(1 - p)
    steps = F.least(k, F.ceil(60 * F.sqrt(n * p) + 200)).cast("int")
    terms = F.aggregate(F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda a, i: F.struct((a["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("term"), (a["sum"] + a["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("sum")))["sum"]
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top + F.ln(terms)))


def _path(held: DataFrame) -> dict[str, list[tuple[str, int]]]:
    """For each stratum the rules in the order in which they come, each with its strictest cutoff: greedily the one with the highest gain on what those before leave. At most strata * rules * (LEVELS + 1) rows of counts come to the driver a round."""
    stack = "stack({}, {}) as (rule, level)".format(len(RULES), ", ".join(f"'{r}', l_{r}" for r in RULES))
    path: dict[str, list[tuple[str, int]]] = {}
    for _ in RULES:
        left = F.lit(True)
        for stratum, steps in path.items():
            for rule, cutoff in steps:
                left = left & ~((F.col("stratum") == stratum) & (F.col(f"l_{rule}") >= cutoff))
        counts = held.where(left & (~F.col("good") | F.col("learns"))).selectExpr("stratum", "good", stack).groupBy("stratum", "rule", "level").agg(F.sum(F.when(F.col("good"), -PRICE * LEARN).otherwise(1)).alias("gain"))
        gains: dict[str, dict[tuple[str, int], int]] = {}
        for r in counts.where("level > 0").collect():
            gains.setdefault(r["stratum"], {})[r["rule"], r["level"]] = r["gain"]
        found = False
        for stratum, by in gains.items():
            totals = [(sum(g for (rule, at), g in by.items() if rule == r and at >= level), level, r) for r, level in by if r not in dict(path.get(stratum, []))]
            gain, level, rule = max(totals, default=(0, 0, ""))
            if gain > 0:
                path.setdefault(stratum, []).append((rule, level))
                found = True
        if not found:
            break
    return path


def calibrate(levelled: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", allowed: float = ALLOWED, error: float = ERROR) -> DataFrame:
    """One row per stratum and rule with a certified cutoff: stratum, rule, cutoff, and of the stratum's cutoffs together p_value, false rejections and good documents, among those that test."""
    spark = levelled.sparkSession
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max("quality").alias("quality"))
    held = levelled.where(~F.col("base_failed")).select(doc_id, "stratum", *[f"l_{r}" for r in RULES])
    held = held.join(known, held[doc_id] == known["__id"])
    learns = F.pmod(F.xxhash64("__id"), F.lit(LEARN)) == 0
    held = written(held.select("stratum", (F.col("quality") == 1).alias("good"), learns.alias("learns"), *[f"l_{r}" for r in RULES]), "labelled")
    path = _path(held)
    # the step of the path that rejects a document first
    step = F.lit(None).cast("int")
    for stratum, steps in path.items():
        at = [F.when(F.col(f"l_{rule}") >= cutoff, i * LEVELS + LEVELS - F.col(f"l_{rule}")) for i, (rule, cutoff) in enumerate(steps)]
        step = F.when(F.col("stratum") == stratum, F.array_min(F.array(*at))).otherwise(step)
    tests = F.col("good") & ~F.col("learns")
    counts = held.withColumn("step", step).groupBy("stratum", "step").agg(F.count_if(tests).alias("tests"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # from here on at most strata * (rules * LEVELS + 1) rows
    sums = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("n", F.sum("tests").over(Window.partitionBy("stratum")).cast("double")).where(F.col("step").isNotNull())
    counts = counts.withColumns({"k": F.sum("tests").over(sums).cast("double"), "gain": F.sum(F.col("bad") - PRICE * F.col("good")).over(sums)})
    tested = counts.where("n > 0").withColumn("p_value", binomial_cdf(F.col("k"), F.col("n"), allowed))
    passed = F.min((F.col("p_value") <= error / (len(STRATA) + 1)).cast("int")).over(sums)
    tested = tested.withColumn("passed", passed).where((F.col("passed") == 1) & (F.col("gain") > 0))
    best = tested.groupBy("stratum").agg(F.max_by(F.struct("step", "p_value", "k", "n"), F.struct("gain", -F.col("step"))).alias("t"))
    rows = []
    for stratum, (last, p_value, k, n) in best.collect():
        for i, (rule, cutoff) in enumerate(path[stratum]):
            if last >= i * LEVELS:
                rows.append((stratum, rule, max(cutoff, i * LEVELS + LEVELS - last), p_value, int(k), int(n)))
    return spark.createDataFrame(rows, "stratum string, rule string, cutoff int, p_value double, false_rejections long, n_good long")


def judge(levelled: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """levelled with kept. At most strata * rules cutoffs come to the driver and become literals of the plan."""
    rejected = F.lit(False)
    for row in sorted(cutoffs.collect()):
        rejected = rejected | ((F.col("stratum") == row["stratum"]) & (F.col(f"l_{row['rule']}") >= row["cutoff"]))
    return levelled.withColumn("kept", ~F.col("base_failed") & ~rejected)


OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = levels(base(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))).drop("text", "lang")
    measured = written(measured, "quality")
    return judge(measured, calibrate(measured, table(spark, sf_dir, "labels"))).select("doc_id", *OWN, "kept")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    own = [f"l_{r}" for r in RULES]
    measured = levels(base(docs.select("doc_id", "text", "lang"))).select("doc_id", "stratum", "base_failed", *own)
    cutoffs = calibrate(written(measured, "quality"), labels)
    # the columns as they came travel in a struct, which no measure can replace
    carried = levels(base(docs.select(F.struct(*docs.columns).alias("__doc"), "text", "lang"))).select("__doc", "stratum", "base_failed", *own)
    # a condition that differs by row stays above the projections; pushed down, it would be written out with every step of them
    judged = judge(carried, cutoffs).withColumn("__row", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("__row") >= 0)).select("__doc.*")
