"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions.  A decision's node is known by the bits of
the byte so far and by the preceding bytes, from none to ``depth`` of them; each
node holds how often 0 and 1 followed in the training texts, its
Krichevsky-Trofimov (KT) probability, and the weighted probability

    Pw(s) = 1/2 KT(s) + 1/2 product of Pw over the contexts one byte longer,

which mixes the estimates of all depths.  A text's score is the sum of the
logarithms of the trained tree's predictions for its bytes and an end symbol: at
each node the KT estimate and the deeper prediction are mixed by their share of
the training code length, and a context that training never met is no node, so
the deepest known one stands as a leaf.

The tree is never in one place.  Texts are dealt into chunks; a chunk counts its
distinct (context, byte) grams and sends them, with its words, to shards by the
two latest context bytes.  A shard merges the counts as they stream in and cuts
its grams where the third latest byte changes, so the nodes of depth 3 and more
lie whole in slices that are worked on one by one; those of depth 2 are sums
over slices.  The sums of depths 0 and 1, whose size is fixed (256 x 255 nodes),
go to the driver.  A slice carries the depth-2 nodes it needs, so the
log-probabilities of its grams are worked out slice by slice, wherever it lies.
Then shards answer the chunks, which stream past, with the log-probability of
each of their grams, and chunks add them up by text.  A shard that is asked much
(common bytes) answers in several tasks, each with its log-probabilities and a
part of the chunks.

What is shuffled is each chunk's distinct grams twice, their answers, the
chunk's compressed texts once, the slices of large shards, and each shard's
log-probabilities.  Chunks grow in number with the input and not in size.  A task
holds a shard's distinct grams (12 bytes for each) or the tree of one slice,
however many chunks there are; a frequent gram or word is one entry of each
chunk that has it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Ends a text and fills the contexts before its first byte; no UTF-8 text has this byte.
END = 0xFF
_TABLE = 1 << 14
_LOGS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _TABLE, dtype=np.float64)))])  # log n!
_HALVES = np.concatenate([[0.0], np.cumsum(np.log(np.arange(0, _TABLE - 1, dtype=np.float64) + 0.5))])  # log Gamma(n + 1/2) - log Gamma(1/2)


def _stirling(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for large x."""
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the KT probability of any sequence with these counts."""

    def half(n: np.ndarray) -> np.ndarray:
        out = _HALVES[np.minimum(n, _TABLE - 1)]
        big = n >= _TABLE
        if big.any():
            out[big] = _stirling(n[big] + 0.5) - 0.5723649429247001
        return out

    total = zeros + ones
    whole = _LOGS[np.minimum(total, _TABLE - 1)]
    big = total >= _TABLE
    if big.any():
        whole[big] = _stirling(total[big] + 1.0)
    return half(zeros) + half(ones) - whole


# ---- packing ----


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte of all numbers in turn, which a codec shrinks well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack(sorted_keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, and their counts."""
    return zstandard.ZstdCompressor(level=3).compress(_planes(np.diff(sorted_keys, prepend=np.uint64(0)).astype("<u8")) + _planes(counts.astype("<u8")))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    half = len(raw) // 2
    return np.cumsum(_from_planes(raw[:half], "<u8"), dtype=np.uint64), _from_planes(raw[half:], "<u8").astype(np.int64)


def pack_numbers(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(_planes(x.astype("<i8")))


def unpack_numbers(data: bytes) -> np.ndarray:
    return _from_planes(zstandard.ZstdDecompressor().decompress(data), "<i8")


def pack_logs(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(_planes(x.astype("<f4")))


def unpack_logs(data: bytes) -> np.ndarray:
    return _from_planes(zstandard.ZstdDecompressor().decompress(data), "<f4")


def pack_texts(texts: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return zstandard.ZstdCompressor(level=3).compress(np.int64(len(texts)).tobytes() + lengths.tobytes() + b"".join(texts))


def unpack_texts(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    ends = (np.cumsum(np.frombuffer(raw[8 : 8 + 8 * n], np.int64)) + 8 + 8 * n).tolist()
    return [raw[a:b] for a, b in zip([8 + 8 * n, *ends], ends, strict=False)]


#: Positions whose keys are made at once.
BLOCK = 1 << 21


def grams(texts: list[bytes], depth: int, block: int = BLOCK) -> Iterator[np.ndarray]:
    """Keys of all positions of all texts, each text's end included, block by block.

    A key has the context's bytes, the latest first, and then the byte itself.
    """
    gap = bytes([END]) * depth
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = depth + np.cumsum(lengths + depth) - (lengths + depth)
    keep = np.ones(len(data) - depth, bool)
    for k in range(1, depth):  # of the gap after a text, its first byte is the end symbol
        keep[begins + lengths + k - depth] = False
    for i in range(0, len(keep), block):
        at = np.flatnonzero(keep[i : i + block]) + i
        wide = data[i : i + block + depth].astype(np.uint64)
        at -= i
        keys = wide[at + depth]
        for k in range(1, depth + 1):
            keys |= wide[at + depth - k] << np.uint64(8 * (depth + 1 - k))
        yield keys


def gram_counts(texts: list[bytes], train: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of some texts in order, and how often those of training have them."""
    flags = np.repeat(train, np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    parts, at = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    for keys in grams(texts, depth):
        parts.append(distinct(keys, flags[at : at + len(keys)]))
        at += len(keys)
    return _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often training positions have them."""
    marked = np.sort((keys << np.uint64(1)) | train.astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], marked[1:] != marked[:-1]])) if len(marked) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(marked)))
    values = marked[first]
    counts = np.where(values & np.uint64(1), counts, 0)
    keys = values >> np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def shard_of_pair(shards: int) -> np.ndarray:
    """Shard of each pair of latest context bytes."""
    h = (np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(shards)).astype(np.int64)


# ---- the tree of one shard ----

#: Grams that a slice of a shard has, or little more: a slice ends where the third latest byte changes.
SLICE = 1 << 17


def slices(keys: np.ndarray, depth: int, rows: int = SLICE) -> list[tuple[int, int]]:
    """Parts of sorted keys that cut no set of grams with the same three latest bytes."""
    if not len(keys):
        return []
    three = keys >> np.uint64(8 * (depth - 2))
    begins = np.flatnonzero(np.concatenate([[True], three[1:] != three[:-1]]))
    cuts = begins[np.unique(begins // rows, return_index=True)[1]].tolist()
    return list(zip(cuts, [*cuts[1:], len(keys)], strict=True))


def _added(names: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct names in order, and the sums of the columns by name."""
    distinct_names, inverse = np.unique(names, return_inverse=True)
    return distinct_names, *(np.bincount(inverse, weights=x, minlength=len(distinct_names)) for x in columns)


class Tree:
    """The nodes of depth 3 and deeper of one slice."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.depth, self.levels = depth, []
        level = {"keys": keys, "counts": counts, "up": None}
        for d in range(depth, 2, -1):
            k, n = level["keys"], level["counts"]
            level["bits"] = [self._nodes(k, n, b) for b in range(8)]
            self.levels.append(level)
            if d > 3:
                shorter = ((k >> np.uint64(16)) << np.uint64(8)) | (k & np.uint64(0xFF))
                up, inverse = np.unique(shorter, return_inverse=True)
                level["up"] = inverse
                level = {"keys": up, "counts": np.bincount(inverse, weights=n, minlength=len(up)).astype(np.int64), "up": None}
        for i, level in enumerate(self.levels):
            for b, node in enumerate(level["bits"]):
                if i == 0:
                    node["children"] = None
                    node["weighted"] = node["kt"]
                else:
                    below = self.levels[i - 1]
                    child = below["bits"][b]
                    parent = node["of"][below["up"][child["first"]]]
                    node["children"] = np.bincount(parent, weights=child["weighted"], minlength=len(node["first"]))
                    node["weighted"] = np.where(node["total"] > 0, np.logaddexp(node["kt"], node["children"]) - np.log(2.0), 0.0)

    @staticmethod
    def _nodes(keys: np.ndarray, counts: np.ndarray, b: int) -> dict:
        """Of the nodes that know ``b`` bits: first row, node of each row, counts, KT."""
        prefix = keys >> np.uint64(8 - b)
        new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
        first = np.flatnonzero(new)
        bit = ((keys >> np.uint64(7 - b)) & np.uint64(1)).astype(np.int64)
        total, ones = np.add.reduceat(counts, first), np.add.reduceat(counts * bit, first)
        return {"first": first, "of": np.cumsum(new) - 1, "total": total, "ones": ones, "bit": bit, "kt": log_kt(total - ones, ones)}

    def sums(self) -> tuple[np.ndarray, ...]:
        """(node of depth 2, zeros, ones, sum of the children's log weights); a node is its two bytes, latest first, x 256 + (1, bits so far)."""
        level = self.levels[-1]
        out = []
        for b, node in enumerate(level["bits"]):
            keys = level["keys"][node["first"]]
            two, sym = (keys >> np.uint64(16)).astype(np.int64), (keys & np.uint64(0xFF)).astype(np.int64)
            out.append((two * 256 + ((1 << b) | (sym >> (8 - b))), node["total"] - node["ones"], node["ones"], node["weighted"]))
        return _added(*(np.concatenate(x) for x in zip(*out, strict=True)))

    def log10(self, two: Second, top: dict) -> np.ndarray:
        """The base-10 logarithm of the weighted prediction of each key's byte after its context."""
        keys = self.levels[0]["keys"]
        rows, sym = np.arange(len(keys)), (keys & np.uint64(0xFF)).astype(np.int64)
        p, seen = [None] * 8, [None] * 8
        for level in self.levels:
            for b in range(8):
                node = level["bits"][b]
                at = node["of"][rows]
                total, ones, bit = node["total"][at], node["ones"][at], node["bit"][rows]
                kt = (np.where(bit == 1, ones, total - ones) + 0.5) / (total + 1.0)
                p[b] = kt if node["children"] is None else _mix(kt, node["kt"][at] - node["children"][at], p[b], seen[b])
                seen[b] = total > 0
            if level["up"] is not None:
                rows = level["up"][rows]
        pair = (keys >> np.uint64(8 * (self.depth - 1))).astype(np.int64)
        out = np.zeros(len(sym))
        for b in range(8):
            heap, bit = (1 << b) | (sym >> (8 - b)), (sym >> (7 - b)) & 1
            at, one = np.searchsorted(two.names, pair * 256 + heap), (pair >> 8) * 256 + heap
            total = two.zeros[at] + two.ones[at]
            q = _mix((np.where(bit == 1, two.ones[at], two.zeros[at]) + 0.5) / (total + 1.0), two.kt[at] - two.children[at], p[b], seen[b])
            q = _mix(top["p1"][one, bit], top["w1"][one], q, total > 0)
            q = _mix(top["p0"][heap, bit], top["w0"][heap], q, top["seen1"][one])
            out += np.log10(q)
        return out


class Second:
    """A shard's nodes of depth 2."""

    def __init__(self, names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray):
        self.names, self.zeros, self.ones, self.children = names, zeros, ones, children
        self.kt = log_kt(zeros.astype(np.int64), ones.astype(np.int64))

    @staticmethod
    def of(keys: np.ndarray, counts: np.ndarray, depth: int) -> Second:
        parts = [Tree(keys[a:b], counts[a:b], depth).sums() for a, b in slices(keys, depth)]
        return Second(*_added(*(np.concatenate(x) for x in zip(*parts, strict=True)))) if parts else Second(np.zeros(0, np.int64), *[np.zeros(0)] * 3)

    def sums(self) -> tuple[np.ndarray, ...]:
        """(node of depth 1, zeros, ones, sum of the children's log weights); a node is its byte x 256 + (1, bits so far)."""
        weighted = np.where(self.zeros + self.ones > 0, np.logaddexp(self.kt, self.children) - np.log(2.0), 0.0)
        return _added((self.names >> 16) * 256 + (self.names & 0xFF), self.zeros, self.ones, weighted)

    def within(self, keys: np.ndarray, depth: int) -> Second:
        """The nodes that these keys' contexts have; the keys stand in order."""
        low, high = ((int(k) >> (8 * (depth - 1))) << 8 for k in (keys[0], keys[-1]))
        a, b = np.searchsorted(self.names, [low, high + 256])
        return Second(self.names[a:b], self.zeros[a:b], self.ones[a:b], self.children[a:b])

    def tobytes(self) -> bytes:
        return np.concatenate([self.names.astype(np.float64), self.zeros, self.ones, self.children]).tobytes()

    @staticmethod
    def frombytes(data: bytes) -> Second:
        names, zeros, ones, children = np.frombuffer(data, np.float64).reshape(4, -1)
        return Second(names.astype(np.int64), zeros, ones, children)


def _mix(kt: np.ndarray, log_odds: np.ndarray, deeper: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """KT and deeper prediction by their share of the code; where nothing deeper was seen, KT alone."""
    w = np.where(seen, 1.0 / (1.0 + np.exp(-np.clip(log_odds, -40, 40))), 1.0)
    return w * kt + (1.0 - w) * deeper


def top_tree(names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> dict:
    """Predictions and odds of the nodes of depths 1 and 0, from depth 1's counts and its children's log weights."""

    def estimates(z: np.ndarray, o: np.ndarray) -> np.ndarray:
        return np.stack([z + 0.5, o + 0.5], axis=-1) / (z + o + 1.0)[..., None]

    z1, o1, c1 = np.zeros(1 << 16), np.zeros(1 << 16), np.zeros(1 << 16)
    z1[names], o1[names], c1[names] = zeros, ones, children
    kt1 = log_kt(z1.astype(np.int64), o1.astype(np.int64))
    weighted = np.where(z1 + o1 > 0, np.logaddexp(kt1, c1) - np.log(2.0), 0.0)
    z0, o0, c0 = (x.reshape(256, 256).sum(axis=0) for x in (z1, o1, weighted))
    kt0 = log_kt(z0.astype(np.int64), o0.astype(np.int64))
    return {"p1": estimates(z1, o1), "w1": kt1 - c1, "seen1": z1 + o1 > 0, "p0": estimates(z0, o0), "w0": kt0 - c0}


# ---- Spark ----


def words_of(text: bytes) -> list[bytes]:
    """The words of a lower-cased text and then the end, one token more."""
    return [*text.split(), bytes([END])]


def _word_shard(words: list[bytes], shards: int) -> np.ndarray:
    """A shard for each word by its bytes, alike in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh32_intdigest(w) % shards for w in words), np.int64, len(words))


def _lookup(table_keys: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[i] for each key, where table_keys[i] is the key: a hash table with linear probing, all keys at once."""
    bits = max(4, int(len(table_keys) * 4).bit_length())
    shift, mask = np.uint64(64 - bits), (1 << bits) - 1
    mult = np.uint64(0x9E3779B97F4A7C15)
    slots = np.full(1 << bits, -1, np.int32)
    left, at = np.arange(len(table_keys), dtype=np.int32), ((table_keys * mult) >> shift).astype(np.int64)
    while len(left):
        free = slots[at] < 0
        slots[at[free]] = left[free]  # of several that claim a slot one stays
        lost = slots[at] != left
        left, at = left[lost], (at[lost] + 1) & mask
    out = np.empty(len(keys), values.dtype)
    for k in range(0, len(keys), 1 << 18):
        part = keys[k : k + (1 << 18)]
        slot = ((part * mult) >> shift).astype(np.int64)
        found = slots[slot]
        wrong = np.flatnonzero(table_keys[found] != part)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & mask
            found[wrong] = slots[slot[wrong]]
            wrong = wrong[table_keys[found[wrong]] != part[wrong]]
        out[k : k + (1 << 18)] = values[found]
    return out


_DEALT = "shard int, chunk long, grams binary, words binary, word_counts binary, texts binary"
_ASK = "shard int, chunk long, grams binary, words binary, word_counts binary"
_MERGED = "shard int, parts int, part int, grams binary, two binary, words binary, word_counts binary"
_KNOWN = "shard int, salt int, chunk long, part int, grams binary, logs binary, words binary, word_counts binary"
_ANSWER = "shard int, chunk long, logs binary, word_counts binary"
#: Bytes of packed grams that a task answers, or as many as its shard's own log-probabilities have; a shard of over ``SHARD_PARTS`` slices has them worked out by several tasks.
TASK_BYTES, SHARD_PARTS = 12 << 20, 8
#: Chunks that are merged at once; more of them are merged in steps.
FAN_IN = 256


def _table(columns: list[list], layout: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in layout.split(", ")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _split(shard: np.ndarray, shards: int) -> list[np.ndarray]:
    """The places of each shard's entries, in their order."""
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards), "right").tolist()
    return [order[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Merger:
    """Sums of the counts of grams and words that stream in; it holds the distinct ones and about as many that wait."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0
        self.words: Counter = Counter()

    def add(self, packed: bytes, words: bytes, word_counts: bytes) -> None:
        self.waiting.append(unpack(packed))
        self.n += len(self.waiting[-1][0])
        if self.n > max(1 << 20, len(self.keys)):
            self.settle()
        if words:
            for w, c in zip(words.split(b" "), unpack_numbers(word_counts).tolist(), strict=True):
                self.words[w] += c

    def settle(self) -> None:
        self.keys, self.counts = _summed(np.concatenate([self.keys, *(k for k, _ in self.waiting)]), np.concatenate([self.counts, *(c for _, c in self.waiting)]))
        self.waiting, self.n = [], 0

    def packed_words(self) -> tuple[bytes, bytes]:
        return b" ".join(self.words), pack_numbers(np.fromiter(self.words.values(), np.int64, len(self.words)))


def _merged(batches: Iterator[pa.RecordBatch]) -> tuple[int, Merger]:
    shard, merger = -1, Merger()
    for b in batches:
        columns = [b.column(c) for c in ("shard", "grams", "words", "word_counts")]
        for i in range(b.num_rows):
            shard, *row = (c[i].as_py() for c in columns)
            merger.add(*row)
    merger.settle()
    return shard, merger


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 5, folds: int = 10, held_fold: int = 0, chunk_bytes: int = 8 << 20) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) for every row.

    Training texts are those whose crc32(id as text) mod ``folds`` isn't
    ``held_fold``; every text is lower-cased (A-Z) and scored whole.  Null texts
    are empty, which scores the end symbol alone; rows that repeat an id are
    texts of their own; a null id counts as the empty text for its fold.
    ``base_score`` is the unigram word model's.  ``depth`` is from 3 to 6.
    A chunk has at most ``chunk_bytes`` of text and one text more.
    """
    if not 3 <= depth <= 6:
        raise ValueError("depth must be from 3 to 6")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (common.crc_bucket(id_col, folds) == held_fold).alias("held_out"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(1 << 16, max(48, -(-total // chunk_bytes)))

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = 0, 0
        ids, texts, held = [], [], []

        def chunk() -> Iterator[pa.RecordBatch]:
            name = (TaskContext.get().partitionId() << 24) + made
            train = ~np.array(held, bool)
            keys, counts = gram_counts(texts, train, depth)
            known: Counter = Counter()
            seen: set[bytes] = set()
            for text, is_train in zip(texts, train.tolist(), strict=True):
                known.update(words_of(text)) if is_train else seen.update(words_of(text))
            words = sorted(seen | known.keys())
            rows = [(-1, name, None, None, None, pack_texts(texts))]
            for s, (mine, own) in enumerate(zip(_split(shard_of_pair(shards)[(keys >> np.uint64(8 * (depth - 1))).astype(np.int64)], shards), _split(_word_shard(words, shards), shards), strict=True)):
                if len(mine) or len(own):
                    w = [words[i] for i in own.tolist()]
                    rows.append((s, name, pack(keys[mine], counts[mine]), b" ".join(w), pack_numbers(np.fromiter((known[x] for x in w), np.int64, len(w))), None))
            b = _table([list(c) for c in zip(*rows, strict=True)], _DEALT)
            more = [pa.array([x, *[None] * (len(rows) - 1)], pa.list_(k)) for x, k in ((ids, id_type), (held, pa.bool_()))]
            yield pa.record_batch([*b.columns, *more], names=[*b.schema.names, "ids", "held"])

        for b in it:
            id_type = b.schema.field(0).type
            for i in range(0, b.num_rows, 200):
                for one, text, is_held in zip(*(c.to_pylist() for c in (b.column(0).slice(i, 200), b.column(1).slice(i, 200).cast(pa.binary()), b.column(2).slice(i, 200))), strict=True):
                    ids.append(one)
                    texts.append((text or b"").translate(_LOWER))
                    held.append(is_held)
                    size += len(texts[-1]) + 1
                    if size >= chunk_bytes:
                        yield from chunk()
                        made, size, ids, texts, held = made + 1, 0, [], [], []
        if ids:
            yield from chunk()

    # texts and what they ask stand in one table, so a task that runs again leaves no half of a chunk
    dealt = common.stored(slim.mapInArrow(deal, f"{_DEALT}, ids array<{kind}>, held array<boolean>"), "ctw-dealt")
    asked = dealt.where("shard >= 0").select(*[x.split()[0] for x in _ASK.split(", ")])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, merger = _merged(batches)
        yield _table([[shard], [0], [pack(merger.keys, merger.counts)], *([x] for x in merger.packed_words())], _ASK)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, merger = _merged(batches)
        keys, counts = merger.keys, merger.counts
        second, cuts = Second.of(keys, counts, depth), slices(keys, depth)
        yield _table([[shard], [len(cuts)], [0], [None], [second.tobytes()], *([x] for x in merger.packed_words())], _MERGED)
        for i, (a, b) in enumerate(cuts):
            yield _table([[shard], [len(cuts)], [i + 1], [pack(keys[a:b], counts[a:b])], [second.within(keys[a:b], depth).tobytes()], [None], [None]], _MERGED)

    counted, left = asked, dealt.where("shard < 0").count()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        counted = counted.groupBy("shard", F.pmod(F.xxhash64("shard", "chunk", "grams"), F.lit(left))).applyInArrow(part, _ASK)
    merged = common.stored(counted.groupBy("shard").applyInArrow(merge, _MERGED), "ctw-counts")

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for two, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name, zeros, ones, children = Second.frombytes(two).sums()
                known = unpack_numbers(words)
                name, zeros = np.append(name, -1), np.append(zeros, known.sum())
                ones, children = np.append(ones, (known > 0).sum()), np.append(children, 0.0)
                yield pa.record_batch([pa.array(name, pa.int32()), pa.array(zeros.astype(np.int64)), pa.array(ones.astype(np.int64)), pa.array(children)], names=["node", "zeros", "ones", "children"])

    by_node = merged.where("part = 0").select("two", "word_counts").mapInArrow(sums, "node int, zeros long, ones long, children double")
    by_node = by_node.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("children").alias("children"))
    rows = sorted(by_node.collect())  # at most 65,281
    n_train, n_distinct = next(((r["zeros"], r["ones"]) for r in rows if r["node"] < 0), (0, 0))
    rows = [r for r in rows if r["node"] >= 0]
    top = top_tree(np.array([r["node"] for r in rows], np.int64), *(np.array([r[c] for r in rows], np.float64) for c in ("zeros", "ones", "children")))
    sent = spark.sparkContext.broadcast(top)

    def predict(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            columns = [b.column(c) for c in b.schema.names]
            for i in range(b.num_rows):
                shard, _, at, packed, second, words, word_counts = (c[i].as_py() for c in columns)
                if at == 0:
                    row = (shard, 0, -1, 0, None, None, words, word_counts)
                else:
                    own, counts = unpack(packed)
                    logs = Tree(own, counts, depth).log10(Second.frombytes(second), sent.value)
                    row = (shard, 0, -1, at, pack(own, np.zeros(len(own), np.int64)), pack_logs(logs), None, None)
                yield _table([[x] for x in row], _KNOWN)

    large = F.col("parts") > SHARD_PARTS
    known = common.stored(merged.where(~large).unionByName(merged.where(large).repartition("shard", "part")).mapInArrow(predict, _KNOWN), "ctw-known")
    common.drop(merged)

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        own, words_known, keys, logs = None, {}, None, None
        for b in it:
            columns, out = [b.column(c) for c in b.schema.names], [[], [], [], []]
            for i in range(b.num_rows):
                shard, salt, chunk, at, packed, packed_logs, words, word_counts = (c[i].as_py() for c in columns)
                if chunk < 0:
                    if own != (shard, salt):
                        own, parts, keys, words_known = (shard, salt), [], None, {}
                    if at == 0:
                        words_known = dict(zip(words.split(b" "), unpack_numbers(word_counts).tolist(), strict=True)) if words else {}
                    else:
                        parts.append((unpack(packed)[0], unpack_logs(packed_logs)))
                    continue
                if keys is None:
                    keys, logs = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in parts)]), np.concatenate([np.zeros(0, np.float32), *(x for _, x in parts)])
                    parts = []
                ws = words.split(b" ") if words else []
                row = (shard, chunk, pack_logs(logs[np.searchsorted(keys, unpack(packed)[0])]), pack_numbers(np.fromiter((words_known[w] for w in ws), np.int64, len(ws))))
                for c, x in zip(out, row, strict=True):
                    c.append(x)
            yield _table(out, _ANSWER)

    # how many tasks answer for each shard; at most 65,536 rows
    heavy = asked.groupBy("shard").agg(F.sum(F.octet_length("grams")).alias("asks"))
    own_bytes = known.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("grams") + F.octet_length("logs"), F.lit(0))).alias("holds"))
    tasks = common.stored(heavy.join(own_bytes, "shard").select("shard", F.ceil(F.col("asks") / F.greatest(F.lit(TASK_BYTES), F.col("holds"))).cast("int").alias("tasks")), "ctw-tasks")
    none = F.lit(None).cast("binary")
    asking = asked.join(F.broadcast(tasks), "shard").select("shard", F.pmod(F.xxhash64("chunk"), F.greatest("tasks", F.lit(1))).cast("int").alias("salt"), "chunk", F.lit(0).alias("part"), "grams", none.alias("logs"), "words", none.alias("word_counts"))
    holding = known.drop("salt").join(F.broadcast(tasks), "shard").select("*", F.explode(F.sequence(F.lit(0), F.greatest("tasks", F.lit(1)) - 1)).alias("salt")).select(*[x.split()[0] for x in _KNOWN.split(", ")])
    # what a shard knows comes first and its chunks after it, so chunks stream past
    answers = holding.unionByName(asking).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "chunk", "part").mapInArrow(answer, _ANSWER)

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = unpack_texts(left.column("texts")[0].as_py())
        words = sorted({w for t in texts for w in words_of(t)})
        own, _ = gram_counts(texts, np.zeros(len(texts), bool), depth)
        mine, mine_words = _split(shard_of_pair(shards)[(own >> np.uint64(8 * (depth - 1))).astype(np.int64)], shards), _split(_word_shard(words, shards), shards)
        logs, known = np.zeros(len(own), np.float32), np.zeros(len(words), np.int64)
        for s, values, numbers in zip(*(right.column(c).to_pylist() for c in ("shard", "logs", "word_counts")), strict=True):
            logs[mine[s]], known[mine_words[s]] = unpack_logs(values), unpack_numbers(numbers)
        counts = dict(zip(words, known.tolist(), strict=True))
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        each = np.concatenate([_lookup(own, k, logs) for k in grams(texts, depth)])
        score = np.add.reduceat(each.astype(np.float64), np.cumsum(size + 1) - (size + 1))
        n, seen, base = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for i, t in enumerate(texts):
            c = np.array([counts[w] for w in words_of(t)], np.float64)
            n[i], seen[i], base[i] = len(c), (c > 0).sum(), np.log10((c + 0.1) / (n_train + 0.1 * (n_distinct + 1))).sum()
        return pa.table([
            left.column("ids").combine_chunks().flatten(), left.column("held").combine_chunks().flatten(), pa.array(n), pa.array(seen), pa.array(np.full(len(n), n_train, np.int64)),
            pa.array(base), pa.array(score), pa.array(size), pa.array(-score / np.log10(2.0) / (size + 1)),
        ], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    whole = dealt.where("shard < 0").select("chunk", "texts", "ids", "held")
    return whole.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add_up, schema).withColumnRenamed("id", id_col)
