"""Language-model scoring by sharded Elias-Fano n-gram tries.

Texts are cut into blocks. A block sends its distinct words, as hashes, to shards by ranges of the hash, which number all words of
the corpus and add up their training counts. With the numbers each block lists its distinct trigrams (of the text between a start
and an end) with their training counts, and sends them to the shards of the trie: by first word, those of a word that is so
common that it fills a shard of its own by the first two, and those of a pair of such words by all three.
A shard merges the lists and builds its trie: level 1 holds the first words, level 2 their successors, level 3 the successors of those.
A level is one monotone sequence, Elias-Fano coded: place of the parent in the level above, then the word; monotone pointers give
each parent's range. A node of level k holds two bytes for the quantised smoothed probability u of its word after its context, and two for
the quantised weight of lower orders after itself. The levels lie in a file that is mapped into memory; what the blocks sent is looked up level
by level, a successor search inside the range of its parent. Each block gets the codes of its n-grams back and its texts are scored.

Smoothing: p_1(w) = (c(w) + 1) / (N + V + 1), from exact counts; p_k(w | context) = u + g p_{k-1}(w | shorter context) with
u = c(context w) / (c(context) + M) and g = M / (c(context) + M), both stored quantised (relative error of 0.01 % down to e^-10, 0.09 % below).
So a node needs no other shard. Every training document counts, no n-gram is left out; the driver gets N, V, one row per shard of words and
the leading words, of which there can't be more than LEADING / 2.

Defined cases: a null text is empty and has one token, the end; a null doc_id counts as the empty text, so it is trained on; repeated
rows are documents of their own; without training documents every count is 0; an empty table gives an empty result; a text
longer than a block is cut at blanks into pieces that overlap by a trigram, and its pieces are added up; columns beside id and text are ignored;
the input may come in another order each time it is read, as the blocks are written out once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

ORDER, MASS = 3, 4.0
#: Bytes of text after which a block is closed; bytes of the corpus for each shard of words and of the trie.
BLOCK, WORD_SHARD, TRIE_SHARD = 8 << 20, 45 << 20, 8 << 20
#: A word is common if it has so many training tokens and one in COMMON bytes of the corpus; a token takes two bytes at least, its blank included.
FULL, COMMON = 2_000_000, 6000
#: Words with a training token in so many bytes of the corpus, of which there are at most half as many, get the smallest numbers, and so many words of a block.
LEADING, FREQUENT = 100_000, 4096
#: Codes are 1 + FINE * -ln(value) down to e^-DEEP, beyond that in steps of COARSE; 0 means absent.
FINE, DEEP, COARSE = 5000.0, 10.0, 600.0
ABSENT = -(1 << 20)
END, START, NONE, FIRST = 0, 1, 2, 3
BLANKS = b" \t\n\x0b\x0c\r"


# --- Elias-Fano -----------------------------------------------------------------------------------------------------------------


class EliasFano:
    """A non-decreasing sequence of n numbers under `universe`: low bits packed, high bits in unary with a count of ones per 64-bit word."""

    def __init__(self, low, high, ones, n: int, width: int):
        self.low, self.high, self.ones, self.n, self.width = low, high, ones, n, width

    @classmethod
    def encode(cls, values, universe: int) -> EliasFano:
        import numpy as np

        values = np.asarray(values, np.uint64)
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        # so many numbers at a time, a multiple of 8, that their bits fit the cache and end with a byte
        places, pieces = np.arange(width, dtype=np.uint64)[None, :], [np.zeros(0, np.uint8)]
        for i in range(0, n if width else 0, 1 << 12):
            bits = (values[i : i + (1 << 12), None] >> places) & np.uint64(1)
            pieces.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
        low = np.concatenate((*pieces, np.zeros(16, np.uint8)))
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = (n + (universe >> width) + 2 + 63) // 64 * 64 + 64
        unary = np.zeros(size, np.uint8)
        unary[at] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))))
        return cls(low, high, ones, n, width)

    def arrays(self) -> dict:
        return {"low": self.low, "high": self.high, "ones": self.ones}

    def lows(self, i):
        """Low bits of the numbers at the places i."""
        import numpy as np

        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        byte, out = bit >> 3, np.zeros(len(i), np.uint64)
        for k in range((self.width + 14) // 8):
            out |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k) if k < 8 else np.uint64(0)
        out >>= (bit & 7).astype(np.uint64)
        if self.width > 56:
            last = self.low[byte + 8].astype(np.uint64)
            out |= np.where(bit & 7, last << (np.uint64(64) - (bit & 7).astype(np.uint64)) % np.uint64(64), np.uint64(0))
        return out & np.uint64((1 << self.width) - 1)

    def _select(self, counts, k, words):
        """Place of the k-th set bit (from 0) of words, whose set bits before each word are counts."""
        import numpy as np

        word = np.searchsorted(counts, k, side="right") - 1
        rest, x, at = k - counts[word], words(word), np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            inside = np.bitwise_count(x & np.uint64((1 << step) - 1)).astype(np.int64)
            over = rest >= inside
            rest = np.where(over, rest - inside, rest)
            at += np.where(over, step, 0)
            x = np.where(over, x >> np.uint64(step), x)
        return word * 64 + at

    def access(self, i):
        """The numbers at the places i."""
        import numpy as np

        place = self._select(self.ones, i, lambda w: self.high[w])
        return ((place - i).astype(np.uint64) << np.uint64(self.width)) | self.lows(i)

    def bucket(self, high):
        """First and last place (exclusive) of the numbers with these high bits."""
        import numpy as np

        zeros = np.arange(len(self.ones)) * 64 - self.ones
        select0 = partial(self._select, zeros, words=lambda w: ~self.high[w])
        at = np.where(high > 0, select0(np.maximum(high - 1, 0)) + 1, 0)
        # the ones from there on are the bucket; where they reach the end of the word, its end is searched for
        rest = ~(self.high[at >> 6] >> (at & 63).astype(np.uint64))
        run = np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        end = at + run
        over = np.flatnonzero((at & 63) + run >= 64)
        end[over] = select0(high[over])
        return at - high, end - high

    def find(self, values, lo=None, hi=None):
        """Place of each value inside [lo, hi), or -1: a successor search by high bits, then by halving on the low ones."""
        import numpy as np

        values = np.asarray(values, np.uint64)
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        high, want = (values >> np.uint64(self.width)).astype(np.int64), values & np.uint64((1 << self.width) - 1)
        a, b = self.bucket(high)
        if lo is not None:
            a, b = np.maximum(a, lo), np.minimum(b, hi)
        end = b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            x, y = a[open_], b[open_]
            mid = (x + y) >> 1
            less = self.lows(mid) < want[open_]
            a[open_], b[open_] = np.where(less, mid + 1, x), np.where(less, y, mid)
            open_ = open_[a[open_] < b[open_]]
        there = a < end
        return np.where(there & (self.lows(np.minimum(a, self.n - 1)) == want), a, -1)


def quantise(values):
    """Two bytes for numbers from 0 to 1: a relative error of 1 / (2 FINE) at most down to e^-DEEP, 1 / (2 COARSE) down to 10^-15; 0 for 0."""
    import numpy as np

    values = np.asarray(values, np.float64)
    x = -np.log(np.where(values > 0, values, 1))
    codes = 1 + np.rint(np.minimum(x, DEEP) * FINE) + np.rint(np.maximum(x - DEEP, 0) * COARSE)
    return np.where(values > 0, np.minimum(codes, 65535), 0).astype(np.uint16)


def value(codes, absent: float):
    import numpy as np

    steps, deep = np.asarray(codes, np.float64) - 1, DEEP * FINE
    return np.where(codes > 0, np.exp(-np.minimum(steps, deep) / FINE - np.maximum(steps - deep, 0) / COARSE), absent)


class Level:
    """One level of a trie: places of the parents in the level above and words, as one monotone sequence; pointers to each parent's first; two bytes each of u and g."""

    def __init__(self, parents, words, above: int, bits: int, u, g):
        """Parallel arrays sorted by parent and word. above: size of the level above. bits: of a word."""
        import numpy as np

        self.bits = np.uint64(bits)
        self.nodes = EliasFano.encode((parents.astype(np.uint64) << self.bits) | words.astype(np.uint64), max(1, above) << bits)
        self.pointers = EliasFano.encode(np.searchsorted(parents, np.arange(above + 1)), len(parents) + 1)
        self.u, self.g = quantise(u), quantise(g)

    def mapped(self, file) -> Level:
        """The same level with its arrays mapped from a file."""
        import numpy as np

        parts = [(x, k, a) for x in (self.nodes, self.pointers) for k, a in x.arrays().items()] + [(self, k, getattr(self, k)) for k in "ug"]
        places = []
        for _, _, a in parts:
            file.write(b"\0" * (-file.tell() % 8))
            places.append(file.tell())
            file.write(np.ascontiguousarray(a).tobytes())
        file.flush()
        for (x, k, a), at in zip(parts, places, strict=True):
            setattr(x, k, np.asarray(np.memmap(file.name, a.dtype, "r", at, a.shape)) if a.size else a)
        return self

    def find(self, parents, words):
        """The place of each word among the successors of its parent, -1 if it or the parent isn't there. The parents ascend."""
        import numpy as np

        out = np.full(len(words), -1, np.int64)
        # so many at a time stay in the cache
        for i in range(0, len(words), 1 << 16):
            there = i + np.flatnonzero(parents[i : i + (1 << 16)] >= 0)
            if len(there):
                parent = parents[there]
                new = np.flatnonzero(np.diff(parent, prepend=-1))
                of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(parent))))
                lo, hi = (self.pointers.access(parent[new] + k).astype(np.int64)[of] for k in (0, 1))
                out[there] = self.nodes.find((parent.astype(np.uint64) << self.bits) | words[there].astype(np.uint64), lo, hi)
        return out

    def codes(self, places):
        import numpy as np

        at = np.maximum(places, 0)
        return [np.where(places >= 0, x[at] if len(x) else 0, 0).astype(np.uint16) for x in (self.u, self.g)]


# --- packed arrays --------------------------------------------------------------------------------------------------------------


def _pack(array) -> bytes:
    """Compressed bytes, the first bytes of all numbers first, without the high bytes that are 0 in all."""
    import numpy as np
    import zstandard

    a = np.ascontiguousarray(array)
    size = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) and a.dtype.kind in "iu" and a.min() >= 0 else a.itemsize
    planes = a.view(np.uint8).reshape(len(a), a.itemsize)[:, :size].T
    return a.dtype.char.encode() + bytes([size]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(raw: bytes):
    import numpy as np
    import zstandard

    kind, size = np.dtype(raw[:1].decode()), raw[1]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[2:]), np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], kind.itemsize), np.uint8)
    out[:, :size] = planes.T
    return out.view(kind).ravel()


def _pack_codes(codes) -> bytes:
    """Of many equal numbers: the distinct ones, most frequent first, and which of them each is."""
    import numpy as np

    own, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(own), np.uint16 if len(own) < 1 << 16 else np.uint32)
    rank[order] = np.arange(len(own))
    return _pack_all(own[order], rank[inverse.ravel()])


def _unpack_codes(body: bytes):
    own, rank = _unpack_all(body)
    return own[rank]


def _joined(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parts(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        size = int.from_bytes(body[at : at + 8], "little")
        out.append(body[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _pack_all(*arrays) -> bytes:
    return _joined([_pack(a) for a in arrays])


def _unpack_all(body: bytes) -> list:
    return [_unpack(x) for x in _parts(body)]


def _differences(keys):
    """Of ascending numbers."""
    import numpy as np

    return np.diff(keys, prepend=keys.dtype.type(0))


def _sums(differences):
    import numpy as np

    return np.cumsum(differences, dtype=differences.dtype)


def _mix(a, b):
    """One 64-bit number of two (a multiply-and-shift mixer)."""
    import numpy as np

    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _range(hashes, shards: int):
    """Equal ranges of the hash."""
    import numpy as np

    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# --- blocks ---------------------------------------------------------------------------------------------------------------------

BLOCKS = pa.schema([("block", pa.string()), ("words", pa.binary()), ("tokens", pa.binary())])


def _pieces(raw: bytes) -> Iterator[tuple[bytes, int, bool]]:
    """A long text in pieces, each with the number of words in front that are context only, and whether it is the last one. All but the last end with a word that looks ahead."""
    at, before = 0, b""
    while True:
        end = min(len(raw), at + BLOCK)
        # up to the end of a word, and then of one more
        for _ in range(2):
            while end < len(raw) and raw[end] in BLANKS:
                end += 1
            while end < len(raw) and raw[end] not in BLANKS:
                end += 1
        words = raw[at:end].rsplit(None, 3)
        last = end >= len(raw) or not raw[end:].strip(BLANKS) or len(words) < 4
        if last:
            yield before + raw[at:], 2 if before else 1, True
            return
        yield before + raw[at:end], 2 if before else 1, False
        before, at = b" ".join(words[-3:-1]) + b" ", end - len(words[-1])


def _split(texts):
    """The distinct words of a string array, which of them each word is, and the number of words of each text."""
    import numpy as np
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    some = pc.not_equal(pc.binary_length(flat), 0)
    counts = np.diff(np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))[np.concatenate(([0], ends))])
    flat = flat.filter(some).dictionary_encode()
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False), counts


def _block(texts, rows, ids, held, contexts, lasts) -> tuple:
    """One row: name, hashes and training counts of the words in order of the hash, and the words of all pieces by their numbers in that order."""
    import numpy as np
    import xxhash

    dictionary, tokens, counts = _split(texts)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(dictionary))
    own, number = np.unique(hashes, return_inverse=True)
    tokens = number[tokens].astype(np.uint32) if len(tokens) else np.zeros(0, np.uint32)
    rows, contexts, lasts, held = (np.asarray(x) for x in (rows, contexts, lasts, held))
    # what a piece has besides its own words is not counted: two words before, one after
    ends = np.cumsum(counts)
    counted = np.repeat((~held).astype(np.int8), counts)
    for i in np.flatnonzero(contexts == 2):
        counted[ends[i] - counts[i] : ends[i] - counts[i] + 2] = 0
    counted[ends[~lasts] - 1] = 0
    train = np.bincount(tokens, weights=counted, minlength=len(own)).astype(np.uint32)
    name = f"{TaskContext.get().partitionId()}-{rows[0]}-{contexts[0]}-{xxhash.xxh3_64_hexdigest(tokens.tobytes())}"
    null = np.array([x is None for x in ids], np.int8)
    pieces = (rows.astype(np.int64), np.array([x or 0 for x in ids], np.int64), null, held.astype(np.int8), contexts.astype(np.int8), lasts.astype(np.int8), counts.astype(np.int64))
    # frequent words get small numbers in front of the others, which takes fewer bytes
    frequent = np.argsort(-np.bincount(tokens, minlength=len(own)), kind="stable")[:FREQUENT].astype(np.uint32)
    number = np.arange(len(own), dtype=np.uint32) + np.uint32(len(frequent))
    number[frequent] = np.arange(len(frequent))
    return name, _pack_all(_differences(own), train), _pack_all(number[tokens], frequent, *pieces)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of doc_id, text, held_out."""
    import numpy as np
    import pyarrow.compute as pc

    open_: list[pa.RecordBatch] = []
    size, row = 0, TaskContext.get().partitionId() << 40

    def close():
        nonlocal row
        if open_:
            rows = pa.Table.from_batches(open_).combine_chunks()
            n = rows.num_rows
            text = pc.fill_null(rows["text"].combine_chunks(), "")
            yield _batch([_block(text, row + np.arange(n), rows["doc_id"].to_pylist(), rows["held_out"].to_numpy(), np.ones(n, np.int8), np.ones(n, bool))], BLOCKS)
            row += n
        open_.clear()

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        for i, length in enumerate(lengths.tolist()):
            if length > BLOCK or size + length > BLOCK:
                if i > at:
                    open_.append(batch.slice(at, i - at))
                yield from close()
                at, size = i, 0
            if length > BLOCK:
                raw = batch.column("text")[i].as_buffer().to_pybytes()
                for piece, context, last in _pieces(raw):
                    text = pa.array([piece], pa.binary()).view(pa.string())
                    yield _batch([_block(text, [row], [batch.column("doc_id")[i].as_py()], [batch.column("held_out")[i].as_py()], [context], [last])], BLOCKS)
                row += 1
                at = i + 1
            else:
                size += length
        if batch.num_rows > at:
            open_.append(batch.slice(at))
    yield from close()


# --- words ----------------------------------------------------------------------------------------------------------------------

SENT = pa.schema([("block", pa.string()), ("shard", pa.int32()), ("body", pa.binary())])
#: Places and counts of the words that a block sent; of the shard itself number, known, train and its leading words.
WORDS = pa.schema([("block", pa.string()), ("shard", pa.int32()), ("body", pa.binary()), ("number", pa.int64()), ("known", pa.int64()), ("train", pa.int64()), ("common", pa.binary())])


def _words(shards: int):
    """Of each block its words by shard."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in batch.to_pylist():
                own, train = _unpack_all(row["words"])
                own = _sums(own)
                cuts = np.searchsorted(_range(own, shards), np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[s], cuts[s + 1])
                    yield _batch([(row["block"], int(s), _pack_all(_differences(own[part]), train[part]))], SENT)

    return send


def _number(leading: int):
    """Numbers the words of a shard from 0 in order of the hash and tells each block the numbers and counts of its own."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rows = [(r["block"], r["shard"], *_unpack_all(r["body"])) for b in batches for r in b.to_pylist()]
        own, inverse = np.unique(np.concatenate([_sums(r[2]) for r in rows]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([r[3] for r in rows]), minlength=len(own)).astype(np.int64)
        often = np.flatnonzero(total >= leading)
        yield _batch([(None, rows[0][1], None, len(own), int((total > 0).sum()), int(total.sum()), _pack_all(often, total[often]))], WORDS)
        at = 0
        for block, shard, keys, _ in rows:
            ids = inverse[at : at + len(keys)]
            at += len(keys)
            yield _batch([(block, shard, _pack_all(_differences(ids), total[ids]), None, None, None, None)], WORDS)

    return number


# --- n-grams --------------------------------------------------------------------------------------------------------------------


class _Grams:
    """The distinct trigrams of a block in the order in which they go to shards, as (w1, w2, w3) of block numbers, with training counts and shards.

    Block numbers are END, START, NONE and then the block's words in order of their numbers in the corpus, so both order alike.
    """

    def __init__(self, tokens: bytes, answers: list[tuple[int, bytes]], numbering, common, shards: int, n_texts: int, full: int, inverse: bool):
        import numpy as np

        words, frequent, self.rows, self.ids, self.null, self.held, self.contexts, lasts, counts = _unpack_all(tokens)
        parts = [(s, *_unpack_all(body)) for s, body in sorted(answers)]
        numbers = []
        for shard, differences, _ in parts:
            places, (offset, own, ids) = _sums(differences), numbering[shard]
            number = offset + places
            at = np.minimum(np.searchsorted(own, places), max(0, len(own) - 1))
            numbers.append(np.where(own[at] == places, ids[at], number) if len(own) else number)
        self.numbers = np.concatenate([np.arange(FIRST, dtype=np.int64), *numbers])
        self.counts = np.concatenate([np.array([n_texts, n_texts, 0]), *[c for _, _, c in parts]])
        # each piece between START, or two words, and END and NONE, or one word that looks ahead
        self.size = counts + np.where(self.contexts == 1, 1, 0) + np.where(lasts == 1, 2, 0)
        self.begin = np.cumsum(self.size) - self.size
        self.seq = np.zeros(self.size.sum(), np.int32)
        first = self.begin[self.contexts == 1]
        self.seq[first] = START
        ends = (self.begin + self.size)[lasts == 1]
        self.seq[ends - 1], own = NONE, np.ones(len(self.seq), bool)
        own[first] = own[ends - 1] = own[ends - 2] = False
        self.seq[own] = np.concatenate((frequent, np.arange(len(self.numbers) - FIRST)))[words] + FIRST
        # a trigram starts everywhere but at the last two of a piece
        self.starts = np.ones(len(self.seq), bool)
        self.starts[self.begin + self.size - 1] = self.starts[self.begin + self.size - 2] = False
        train = np.repeat(self.held == 0, self.size)
        train[self.begin[self.contexts == 2]] = False
        at = np.flatnonzero(self.starts)
        nth = lambda k: self.seq[at + k].astype(np.int64)
        width = len(self.numbers).bit_length()
        if 3 * width < 64:
            keys = nth(0) << width
            keys |= nth(1)
            keys <<= width
            keys |= nth(2)
            low = np.int64((1 << width) - 1)
            whole = lambda k: (k >> (2 * width), (k >> width) & low, k & low)
        else:
            pairs, pair = np.unique((nth(0) << 32) | nth(1), return_inverse=True)
            keys = (pair << 32) | nth(2)
            whole = lambda k: (pairs[k >> 32] >> 32, pairs[k >> 32] & 0xFFFFFFFF, k & 0xFFFFFFFF)
        if inverse:
            grams, self.inverse = np.unique(keys, return_inverse=True)
            n = np.zeros(len(grams), np.int32)
        else:
            keys = np.sort((keys.view(np.uint64) << np.uint64(1)) | train[at].astype(np.uint64))
            trained, keys = (keys & np.uint64(1)).astype(np.int32), (keys >> np.uint64(1)).view(np.int64)
            new = np.flatnonzero(np.diff(keys, prepend=-1))
            grams, n = keys[new], np.add.reduceat(trained, new) if len(new) else np.zeros(0, np.int32)
        del keys, at, train
        w1, w2, w3 = (w.astype(np.int32) for w in whole(grams))
        del grams
        # shards of the pairs; pairs of common words are split by the third
        pair = np.flatnonzero((np.diff(w1, prepend=-1) != 0) | (np.diff(w2, prepend=-1) != 0))
        of = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(w1))))
        p1, p2 = w1[pair], w2[pair]
        is_common = np.isin(self.numbers, common[0]) if len(common[0]) else np.zeros(len(self.numbers), bool)
        both = is_common[p1] & is_common[p2] & (p2 != END)
        splits = np.where(both, np.minimum(self.counts[p1], self.counts[p2]) // full, 1)
        hashes = _mix(self.numbers[p1].astype(np.uint64), np.where(is_common[p1], self.numbers[p2] + 1, 0).astype(np.uint64))
        shard = hashes[of]
        for i in np.flatnonzero(splits > 1):
            part = slice(pair[i], pair[i + 1] if i + 1 < len(pair) else len(w1))
            shard[part] = _mix(shard[part], _mix(self.numbers[w3[part]].astype(np.uint64), np.uint64(1)) % np.uint64(splits[i]) + np.uint64(1))
        shard = _range(shard, shards)
        # each part of a split pair is told the count of the pair, as that of a successor that can't be
        extra = []
        for i in np.flatnonzero(splits > 1):
            count = n[pair[i] : pair[i + 1] if i + 1 < len(pair) else len(w1)].sum()
            # parts may meet in a shard, which is told once
            own = np.unique(_range(_mix(hashes[i], np.arange(1, splits[i] + 1).astype(np.uint64)), shards))
            extra += [(p1[i], p2[i], count, s) for s in own]
        if extra:
            e1, e2, en, es = (np.array(x, np.int64) for x in zip(*extra, strict=True))
            w1, w2, w3 = np.concatenate((w1, e1)), np.concatenate((w2, e2)), np.concatenate((w3, np.full(len(e1), START)))
            n, shard = np.concatenate((n, en)), np.concatenate((shard, es))
            order = np.lexsort((w3, w2, w1, shard))
        else:
            order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
        del of, hashes
        self.w1, self.w2, self.w3, self.n, self.shard, self.order = w1[order], w2[order], w3[order], n[order], shard[order], order
        # within a shard, where a word and a pair come first
        change = np.diff(self.shard, prepend=-1) != 0
        self.new1 = change | (np.diff(self.w1, prepend=-1) != 0)
        self.new2 = self.new1 | (np.diff(self.w2, prepend=-1) != 0)
        self.cuts = np.flatnonzero(change)

    def messages(self) -> Iterator[tuple[int, bytes]]:
        """For each shard the block's part of the trie: words and number of children of the first two levels, words and counts of the third."""
        import numpy as np

        for lo, hi in zip(self.cuts, np.append(self.cuts[1:], len(self.shard)), strict=True):
            one, two = np.flatnonzero(self.new1[lo:hi]), np.flatnonzero(self.new2[lo:hi])
            children1 = np.diff(np.append(np.searchsorted(two, one), len(two)))
            children2 = np.diff(np.append(two, hi - lo))
            number = lambda w: self.numbers[w[lo:hi]]  # noqa: B023, E731
            yield int(self.shard[lo]), _pack_all(number(self.w1)[one], children1, number(self.w2)[two], children2, number(self.w3), self.n[lo:hi])


def _ask(numbering, common, shards: int, n_texts: int, full: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tokens, answers, _ = _gathered(batches)
        grams = _Grams(tokens, answers, numbering, common, shards, n_texts, full, False)
        for shard, body in grams.messages():
            yield _batch([(name, shard, body)], SENT)

    return ask


#: What a block is given: its tokens (kind 0), numbers and counts of its words (1) and codes of its n-grams (2).
GIVEN = "block string, kind int, shard int, body binary"


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[str, bytes, list, list]:
    name, tokens, given = "", None, {1: [], 2: []}
    for batch in batches:
        for row in batch.to_pylist():
            name = row["block"]
            if row["kind"]:
                given[row["kind"]].append((row["shard"], row["body"]))
            else:
                tokens = row["body"]
    return name, tokens, given[1], given[2]


def _trie(common):
    """One shard of the trie: built of all that the blocks sent, and asked for it."""

    def trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tempfile

        import numpy as np

        rows, parts = [], []
        for batch in batches:
            for r in batch.to_pylist():
                parts.append(_unpack_all(r["body"]))
                rows.append((r["block"], r["shard"], *(len(parts[-1][i]) for i in (0, 2, 4))))
        columns = list(zip(*parts, strict=True))
        parts.clear()

        def every(i: int):
            out = np.concatenate(columns[i])
            columns[i] = ()
            return out

        one, at1 = np.unique(every(0), return_inverse=True)
        key2, at2 = np.unique((np.repeat(at1, every(1)) << 40) | every(2), return_inverse=True)
        key3, at3 = np.unique((np.repeat(at2, every(3)) << 40) | every(4), return_inverse=True)
        c3 = np.bincount(at3, weights=every(5), minlength=len(key3))
        word = np.int64((1 << 40) - 1)
        parent2, two, parent3, three = key2 >> 40, key2 & word, key3 >> 40, key3 & word
        # a pair's count is the sum over its successors, or what was sent for the whole of a split one
        told = three == START
        c2 = np.bincount(parent3, weights=np.where(told, 0, c3), minlength=len(two))
        c2[parent3[told]] = c3[told]
        c1 = np.bincount(parent2, weights=c2, minlength=len(one))
        place = np.searchsorted(common[0], one) if len(common[0]) else np.zeros(0, np.int64)
        if len(place):
            place = np.minimum(place, len(common[0]) - 1)
            c1 = np.where(common[0][place] == one, common[1][place], c1)
        # only what was seen in training is in the trie
        bits = max(int(x.max(initial=1)) for x in (one, two, three)).bit_length()
        in1, in2, in3 = c1 > 0, c2 > 0, (c3 > 0) & ~told
        rank = lambda there: np.cumsum(there) - 1
        with tempfile.NamedTemporaryFile(prefix="trie-") as file:
            levels = [
                Level(np.zeros(in1.sum(), np.int64), one[in1], 1, bits, np.zeros(in1.sum()), MASS / (c1[in1] + MASS)).mapped(file),
                Level(rank(in1)[parent2[in2]], two[in2], int(in1.sum()), bits, c2[in2] / (c1[parent2[in2]] + MASS), MASS / (c2[in2] + MASS)).mapped(file),
                Level(rank(in2)[parent3[in3]], three[in3], int(in2.sum()), bits, c3[in3] / (c2[parent3[in3]] + MASS), np.zeros(in3.sum())).mapped(file),
            ]
            found1 = levels[0].find(np.zeros(len(one), np.int64), one)
            found2 = levels[1].find(found1[parent2], two)
            found3 = levels[2].find(found2[parent3], three)
            (_, g1), (u2, g2), (u3, _) = (x.codes(f) for x, f in zip(levels, (found1, found2, found3), strict=True))
        # u is sent by its distance from the parent's g, which depends on little but the n-gram's own count
        u2, u3 = (np.where(u > 0, u.astype(np.int32) - g[of], ABSENT) for u, g, of in ((u2, g1, parent2), (u3, g2, parent3)))
        del found1, found2, found3, levels, c1, c2, c3, key2, key3, parent2, parent3, two, three
        a, b, c = 0, 0, 0
        for block, shard, n1, n2, n3 in rows:
            i, j, k = at1[a : a + n1], at2[b : b + n2], at3[c : c + n3]
            yield _batch([(block, shard, _joined([_pack_codes(x) for x in (g1[i], u2[j], g2[j], u3[k])]))], SENT)
            a, b, c = a + n1, b + n2, c + n3

    return trie


SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(order: int, numbering, common, shards: int, n_texts: int, full: int, n: int, v: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        _, tokens, words, codes = _gathered(batches)
        grams = _Grams(tokens, words, numbering, common, shards, n_texts, full, True)
        parts = [[_unpack_codes(x) for x in _parts(body)] for _, body in sorted(codes)]
        g1, u2, g2, u3 = (np.concatenate([p[i] for p in parts]) for i in range(4))
        of1, of2 = (np.cumsum(new, dtype=np.int32) - 1 for new in (grams.new1, grams.new2))
        u2, u3 = (np.where(u != ABSENT, u + g[of], 0) for u, g, of in ((u2, g1, of1[grams.new2]), (u3, g2, of2)))
        g1, u2, g2, u3 = (value(x, absent).astype(np.float32) for x, absent in ((g1, 1), (u2, 0), (g2, 1), (u3, 0)))
        # codes lie as the n-grams were sent; back to the order of the distinct ones
        n_grams = int(grams.order.max(initial=-1)) + 1
        back = np.empty(n_grams, np.int64)
        back[grams.order] = np.arange(n_grams)
        del parts
        at = np.full(len(grams.seq), -1, np.int64)
        at[grams.starts] = back[grams.inverse]
        scored = np.ones(len(grams.seq), bool)
        scored[grams.begin] = scored[grams.begin + grams.size - 1] = False
        scored[grams.begin[grams.contexts == 2] + 1] = False
        j = np.flatnonzero(scored)
        count = grams.counts[grams.seq[j]]
        p1 = (count + 1) / (n + v + 1)
        pair = at[j - 1]
        p = low = u2[of2[pair]] + g1[of1[pair]] * p1
        if order > 2:
            # the first word of a text has START twice before it, which is as good as once
            first = grams.seq[j - 1] == START
            gram = np.where(first, pair, at[np.maximum(j - 2, 0)])
            p = np.where(first, u2[of2[pair]] + g1[of1[pair]] * low, u3[gram] + g2[of2[gram]] * low)
        piece = np.repeat(np.arange(len(grams.size)), grams.size)[j]
        sums = lambda x: np.bincount(piece, weights=x, minlength=len(grams.size))
        columns = [pa.array(grams.rows), pa.array(grams.ids, mask=grams.null.astype(bool)), pa.array(grams.held == 1), pa.array(np.bincount(piece, minlength=len(grams.size))), pa.array(sums(count > 0).astype(np.int64)), pa.array(sums(np.log10(p1))), pa.array(sums(np.log10(p)))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return score


def score(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row. order: 2 or 3."""
    if order not in (2, 3):
        raise ValueError("the trie has three levels; order is 2 or 3")
    import numpy as np

    held = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), held.alias("held_out"))
    size, n_texts = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1), F.count_if(~F.col("held_out"))).first()
    size = size or 0
    full = max(FULL, size // COMMON)
    blocks = written(docs.mapInArrow(_cut, "block string, words binary, tokens binary"), "blocks")
    sent = blocks.select("block", "words").mapInArrow(_words(max(8, size // WORD_SHARD)), "block string, shard int, body binary")
    words = sent.groupBy("shard").applyInArrow(_number(max(1, size // LEADING)), "block string, shard int, body binary, number long, known long, train long, common binary")
    words = written(words, "words")
    sizes = {r["shard"]: r for r in words.where("number is not null").select("shard", "number", "known", "train", "common").collect()}
    leading = sorted((-c, s, i) for s, r in sizes.items() for i, c in zip(*(x.tolist() for x in _unpack_all(r["common"])), strict=True))
    n, v, at, numbering = n_texts, int(n_texts > 0), FIRST + len(leading), {}
    ids = {(s, i): FIRST + k for k, (_, s, i) in enumerate(leading)}
    for s in sorted(sizes):
        own = sorted((i, k) for (shard, i), k in ids.items() if shard == s)
        numbering[s] = (at, *(np.array(x, np.int64) for x in (zip(*own, strict=True) if own else ((), ()))))
        at, n, v = at + sizes[s]["number"], n + sizes[s]["train"], v + sizes[s]["known"]
    often = sorted([(START, n_texts)] * (n_texts >= full) + [(ids[s, i], -c) for c, s, i in leading if -c >= full])
    common = tuple(np.array(x, np.int64) for x in (zip(*often, strict=True) if often else ((), ())))
    shards = max(8, size // TRIE_SHARD)
    given = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).alias("shard"), F.col("tokens").alias("body"))
    given = given.union(words.where("block is not null").select("block", F.lit(1).alias("kind"), "shard", "body"))
    asked = given.groupBy("block").applyInArrow(_ask(numbering, common, shards, n_texts, full), "block string, shard int, body binary")
    codes = asked.groupBy("shard").applyInArrow(_trie(common), "block string, shard int, body binary")
    given = given.union(codes.select("block", F.lit(2).alias("kind"), "shard", "body"))
    pieces = given.groupBy("block").applyInArrow(_score(order, numbering, common, shards, n_texts, full, n, v), SCORES)
    # the pieces of a long text are added up; all others are alone in their group
    out = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
