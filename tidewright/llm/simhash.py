"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints: each bit is set if it is set in over half of the 64-bit hashes of a text's word shingles.
Links: two fingerprints that differ in up to 3 bits have a variant in common that one reaches by at most one flipped bit and
the other by at most two. An odd distance means that one has an even and the other an odd number of set bits, so only
those with an odd number emit two-bit variants; and as two of any three positions fall in the same half of the word, only pairs inside a
half are needed. That leaves 65 variants for even and 1,057 for odd fingerprints and loses no pair.
All that meet in a variant are linked to the smallest that reached it by one flip or none, so a variant
costs as many edges as it has members, never the square; each edge is then verified by its distance.
Components: each node points at its smallest neighbour, pointers are followed to their ends, and the ends take the nodes' places in the edges
that are left, until none is; so all edges are read once, and each round leaves half the nodes at most.

Defined cases: a null text has no words; texts without words have fingerprint zero and link like any others; texts of fewer words
than a shingle have one shingle; repeated rows and equal ids count as copies; rows with a null id get
a component from the others in it (null if none has an id); an empty table gives an empty result; further columns pass through
fingerprinted(), whose own column replaces one of the same name.

deduplicate(), the stage, links texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more; texts with equal sets are one from the
start. Candidates come by the method above, from the fingerprints of these sets: all of one component are a bucket. At a similarity of 0.8
fingerprints differ in some 10 of 64 bits, which no ball reaches (half the radius alone gives 8 million variants each), so
further candidates share a band of minima (MinHash), a bucket each: at 0.8 a pair is missed with
probability (1 - 0.8^ROWS)^BANDS, under 0.001. All candidates that could join two components are verified on the whole sets: first each with
one member of its bucket, which joins large groups at a cost in proportion to their size. Buckets that still hold several
components are joined into clusters, which are compared in whole: cut into blocks of BLOCK sets, each pair of blocks in a task that counts shared
shingles by postings and returns only the links that join components. A cluster of n sets so sends n * n / BLOCK rows and returns
no more than 2 BLOCK a task; this part grows with the square of a cluster, whose members are candidates but not near copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import repeat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructType

from .common import table, written

SHINGLE, SEED, RADIUS = 3, 42, 3
#: The stage's words a shingle and least similarity, as a fraction; bands of so many minima each.
STAGE_SHINGLE, SIMILAR, BANDS, ROWS = 5, (4, 5), 40, 8
#: Sets in a block that are compared with those of another in one task.
BLOCK = 250
#: A text is split into words by so many bytes at a time.
CHUNK = 1 << 20
#: Parts into which the rows of one fingerprint are dealt where they meet its component.
SALTS = 8
#: Variants by one flip or none, 130 for each fingerprint, per partition of the join that finds collisions; the others stream past them.
PER_PARTITION = 1_000_000


def _pieces(raw: bytes, width: int = SHINGLE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded length; each list starts with the last words of the one before."""
    last: list[bytes] = []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = last + raw[at:end].split()
        yield words
        last = words[1 - width :]
        at = end


def fingerprint(raw: bytes) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit number."""
    import numpy as np
    import xxhash

    raw = raw.lower()
    ones, n, few = np.zeros(64, np.int64), 0, []
    for words in _pieces(raw):
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        for i in range(0, len(h), 1 << 14):
            part = h[i : i + (1 << 14)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
        few = words
    if not n and few:
        n, h = 1, np.array([xxhash.xxh64_intdigest(b" ".join(few), SEED)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little")
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


@F.arrow_udf(LongType())
def _fingerprints(texts):
    import pyarrow as pa

    return pa.array([fingerprint(x.as_py()) if x.is_valid else 0 for x in texts.cast(pa.binary())], pa.int64())


def fingerprinted(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("fingerprint", _fingerprints(F.col(text)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(half: int) -> tuple[list[int], list[int]]:
    """What to flip in one half of the word (0: low, 1: high): no bit and each one; besides, each pair."""
    bits = [1 << i for i in range(32 * half, 32 * half + 32)]
    ones = [0, *bits]
    return [_signed(x) for x in ones], [_signed(x) for x in ones + [x | y for i, x in enumerate(bits) for y in bits[i + 1 :]]]


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, by which all that link at RADIUS or fewer bits are connected; a written table. prints: one column, fingerprint, without repeats.

    Variants that flip bits of one half only share the other half, the key. So a fingerprint travels by key, with all of them in one
    row, and they are written out behind the shuffle; only variants that flip a bit of the key have rows of their own.
    """
    spark, fp, key = prints.sparkSession, F.col("fingerprint"), F.col("key")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), prints.count() * 130 // PER_PARTITION)
    low, high = F.lit((1 << 32) - 1), F.lit(-1 << 32)
    # a key is the half that stays; bit 32 is set if that is the low one
    halves = F.array(F.shiftrightunsigned(fp, 32), fp.bitwiseAND(low).bitwiseOR(F.lit(1 << 32)))
    sent = lambda flips: prints.select(fp, F.explode(halves).alias("half")).select(fp, "half", F.explode(F.lit(flips)).alias("flip")).select(fp, F.col("half").bitwiseXOR(F.col("flip")).alias("key")).repartition(parts, "key")
    is_high = key < (1 << 32)
    (one_low, two_low), (one_high, two_high) = masks(0), masks(1)
    one = F.when(is_high, F.lit(one_low)).otherwise(F.lit(one_high))
    two = F.when(is_high, F.lit(two_low)).otherwise(F.lit(two_high))
    # the fingerprint with the key put back in its place
    base = F.when(is_high, F.shiftleft(key, 32).bitwiseOR(fp.bitwiseAND(low))).otherwise(fp.bitwiseAND(high).bitwiseOR(key.bitwiseAND(low)))
    spread = lambda rows, flips: rows.select(key, fp, base.alias("base"), F.explode(flips).alias("mask")).select(key, fp, F.col("base").bitwiseXOR(F.col("mask")).alias("variant"))
    centres = spread(sent(one_low), F.when(base == fp, one).otherwise(F.array(F.lit(0).cast("long"))))
    centres = centres.groupBy("key", "variant").agg(F.min(fp).alias("b"))
    members = spread(sent([0]), F.when(F.bit_count(fp) % 2 == 1, two).otherwise(one))
    met = members.join(centres.hint("shuffle_hash"), ["key", "variant"]).select(fp.alias("a"), "b").where("a != b")
    met = met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()
    # both sides of the join lie by key already, which is enough for a join by key and variant
    strict = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(strict)
    spark.conf.set(strict, "false")
    try:
        return written(met, "links")
    finally:
        spark.conf.set(strict, before)


def _followed(labels: DataFrame) -> DataFrame:
    """labels (node and root, which is a node) with the end of the way from each node by roots."""
    while True:
        jump = labels.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        better = written(labels.join(jump, F.col("root") == F.col("__n")).select("node", F.col("root").alias("old"), F.col("__r").alias("root")), "roots")
        labels = better.select("node", "root")
        if better.where("old != root").isEmpty():
            return labels


def components(edges: DataFrame) -> DataFrame:
    """For each node with an edge (a, b) to another its root: the smallest that it reaches."""
    edges = written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while True:
        near = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"))
        labels = _followed(written(near, "roots"))
        step = lambda key, to, labels=labels: labels.select(F.col("node").alias(key), F.col("root").alias(to))
        if roots is None:
            roots = labels
        else:
            roots = written(roots.join(step("__n", "__r"), F.col("root") == F.col("__n"), "left").select("node", F.coalesce("__r", "root").alias("root")), "roots")
        # edges inside a tree go, the others join the trees' roots from now on
        left = edges.join(step("__n", "__a"), F.col("a") == F.col("__n")).join(step("node", "__b"), F.col("b") == F.col("node")).where("__a != __b")
        edges = written(left.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return roots


def groups(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """prints (doc_id and fingerprint) with component_id, the smallest doc_id that is reached."""
    per = written(prints.groupBy("fingerprint").agg(F.min(doc_id).alias("first_id")), "prints")
    roots = components(links(per.select("fingerprint")))
    linked = roots.join(per, F.col("node") == F.col("fingerprint")).select("node", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = linked.join(least, "root").select("node", "least_id")
    named = per.join(linked, F.col("fingerprint") == F.col("node"), "left").select(F.col("fingerprint").alias("__f"), F.coalesce("least_id", "first_id").alias("component_id"))
    # a text with many copies is met in SALTS places
    named = named.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = prints.withColumn("__salt", F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int"))
    return salted.join(named, (F.col("fingerprint") == F.col("__f")) & (F.col("__salt") == F.col("__s"))).drop("__f", "__s", "__salt")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(fingerprinted(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint"), "fingerprints")
    return groups(prints).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(raw: bytes):
    """The distinct hashes of a text's shingles of STAGE_SHINGLE words, sorted; of fewer words the one of them all, of none none."""
    import numpy as np
    import xxhash

    found, few = [], []
    for words in _pieces(raw.lower(), STAGE_SHINGLE):
        shingles = map(b" ".join, zip(*(words[i:] for i in range(STAGE_SHINGLE)), strict=False))
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64))
        few = words
    if few and not any(map(len, found)):
        found = [np.array([xxhash.xxh64_intdigest(b" ".join(few), SEED)], np.uint64)]
    return np.unique(np.concatenate(found)) if found else np.array([], np.uint64)


@cache
def _permutations():
    """What hashes are XORed with and the odd factors that they are multiplied by."""
    import numpy as np

    flip, factor = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
    return flip, factor | np.uint64(1)


def bands(hashes) -> list[int]:
    """A key for each band, the hash of its number and of the minima of ROWS permutations of the set; none of an empty set."""
    import numpy as np
    import xxhash

    if not len(hashes):
        return []
    flip, factor = _permutations()
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[i : i + 2048] ^ flip) * factor).min(axis=1))
    return [_signed(xxhash.xxh64_intdigest(x.tobytes(), i)) for i, x in enumerate(least.reshape(BANDS, ROWS))]


def set_fingerprint(hashes) -> int | None:
    """The fingerprint of a set of shingles, as a signed 64-bit number; none of an empty set."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0]) if len(hashes) else None


def _set_id(hashes) -> int:
    import xxhash

    return _signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))


@F.arrow_udf(StructType().add("set", LongType()).add("fingerprint", LongType()).add("bands", ArrayType(LongType())))
def _sketches(texts):
    import pyarrow as pa

    sets = [shingle_set(x.as_py() if x.is_valid else b"") for x in texts.cast(pa.binary())]
    made = [pa.array(map(_set_id, sets), pa.int64()), pa.array(map(set_fingerprint, sets), pa.int64()), pa.array(map(bands, sets), pa.list_(pa.int64()))]
    return pa.StructArray.from_arrays(made, ["set", "fingerprint", "bands"])


@F.arrow_udf(BinaryType())
def _sets(texts):
    import pyarrow as pa

    return pa.array([shingle_set(x.as_py() if x.is_valid else b"").tobytes() for x in texts.cast(pa.binary())], pa.binary())


def _similar_sizes(both, a, b):
    """Whether sets of a and b hashes that share so many are similar."""
    part, whole = SIMILAR
    return whole * both >= part * (a + b - both)


@F.arrow_udf(BooleanType())
def _similar(a, b):
    import numpy as np
    import pyarrow as pa

    def similar(x: bytes, y: bytes) -> bool:
        n, m = len(x) // 8, len(y) // 8
        # no more can be shared than the smaller set holds
        if not _similar_sizes(min(n, m), n, m):
            return False
        return _similar_sizes(len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)), n, m)

    return pa.array([similar(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.bool_())


def _compare(table):
    """Links (a, b) between the sets of two blocks (side 0 and 1, or all of one block) by which all that are similar are connected, beyond what their roots connect already."""
    import numpy as np
    import pyarrow as pa

    own = {r["set"]: r for r in table.to_pylist()}
    same = table["i"][0].as_py() == table["j"][0].as_py()
    one, two = ([r for r in own.values() if same or r["side"] == k] for k in (0, 1))
    out: list[tuple[int, int]] = []
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while joined.get(x, x) != x:
            joined[x] = joined.get(joined[x], joined[x])
            x = joined[x]
        return x

    if one and two:
        sets = [np.frombuffer(r["hashes"], np.uint64) for r in one]
        owner, hashes = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        by = np.argsort(hashes, kind="stable")
        owner, hashes, sizes = owner[by], hashes[by], np.array([len(x) for x in sets])
        for row in two:
            x = np.frombuffer(row["hashes"], np.uint64)
            lo, n = np.searchsorted(hashes, x), np.searchsorted(hashes, x, side="right")
            n -= lo
            # the postings of all hashes of x, one after the other
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            for k in np.flatnonzero(_similar_sizes(both, sizes, len(x))).tolist():
                a, b = root(one[k]["root"]), root(row["root"])
                if a != b:
                    joined[max(a, b)] = min(a, b)
                    out.append((one[k]["set"], row["set"]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of set ids those that are similar."""
    side = lambda name: sets.select(F.col("set").alias(name), F.col("hashes").alias(f"__{name}"))
    pairs = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    return written(pairs.where(_similar("__a", "__b")).select("a", "b"), "similar")


def near_copies(sketches: DataFrame, sets_of) -> DataFrame:
    """For each set id that is a near copy of another its root, as components() gives them. sketches: set, fingerprint and bands, one row each; sets_of(ids): a table of
    set and hashes."""
    prints = written(sketches.where("fingerprint is not null").select("fingerprint").distinct(), "prints")
    reached = components(links(prints)).select(F.col("node").alias("__n"), F.col("root").alias("__root"))
    # a bucket for each component of fingerprints and for each band
    balls = sketches.where("fingerprint is not null").join(reached, F.col("fingerprint") == F.col("__n"), "left").select("set", F.xxhash64(F.coalesce("__root", "fingerprint")).alias("key"))
    keys = written(sketches.select("set", F.explode("bands").alias("key")).union(balls), "bands")
    # each bucket has a centre of its own, so a large group gets as many as it has buckets
    mixed = F.struct(F.xxhash64("set", "key").alias("h"), "set")
    centres = keys.groupBy("key").agg(F.min(mixed)["set"].alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = written(keys.join(centres, "key"), "shared")
    sets = written(sets_of(shared.select("set").distinct()), "sets")
    edges = _verified(shared.where("set != b").select(F.least("set", "b").alias("a"), F.greatest("set", "b").alias("b")), sets)
    roots = components(edges)
    placed = shared.select("key", "set").join(roots, F.col("set") == F.col("node"), "left").select("key", "set", F.coalesce("root", "set").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    placed = written(placed.join(split, "key"), "split")
    if placed.isEmpty():
        return roots
    # what buckets with several components connect is compared in whole, block by block
    clusters = components(placed.where("root != lo").select(F.col("lo").alias("a"), F.col("root").alias("b")).distinct())
    members = placed.select("set", "root").distinct().join(clusters.select("node", F.col("root").alias("cluster")), F.col("root") == F.col("node")).drop("node")
    members = written(members, "members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("set", F.lit(1)), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "cluster").join(sets, "set").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "set", "root", "hashes")
    more = written(dealt.groupBy("cluster", "i", "j").applyInArrow(_compare, "a long, b long"), "similar")
    return roots if more.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id (nulls last) and of these the smallest hash of its text, with the columns they came with."""
    digest = F.xxhash64("text")
    sketched = docs.select("doc_id", digest.alias("digest"), _sketches("text").alias("s"))
    sketched = written(sketched.select("doc_id", "digest", "s.set", "s.fingerprint", "s.bands"), "sketches")
    rows = sketched.groupBy("set", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = written(rows.groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "n")).alias("first")), "first")

    def sets_of(ids: DataFrame) -> DataFrame:
        held = ids.join(first, "set").select("set", F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__digest"))
        texts = docs.select("doc_id", "text").join(held, F.col("doc_id").eqNullSafe(F.col("__id")) & (digest == F.col("__digest")))
        return texts.dropDuplicates(["set"]).select("set", _sets("text").alias("hashes"))

    roots = near_copies(sketched.groupBy("set").agg(F.first("fingerprint").alias("fingerprint"), F.first("bands").alias("bands")), sets_of)
    named = first.join(roots, F.col("set") == F.col("node"), "left").select(F.coalesce("root", "set").alias("root"), "first")
    stay = named.groupBy("root").agg(F.min("first").alias("first"))
    stay = written(stay.select(F.col("root").alias("__root"), F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__digest"), F.col("first.n").alias("__n")), "stay")
    kept = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (digest == F.col("__digest")))
    # only rows that are alike in id and text need to be told apart
    kept = kept.where("__n = 1").union(kept.where("__n > 1").dropDuplicates(["__root"]))
    return kept.drop("__root", "__id", "__digest", "__n")
