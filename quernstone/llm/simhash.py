"""SimHash near-duplicates by segment bit counts.

A fingerprint's bits are cut into segments of one or two, and the counts of ones
by segment are a point whose Manhattan distance to another point never exceeds
the fingerprints' Hamming distance.  Points are joined on a grid over groups of
coordinates.  For small distances a pigeonhole gives the groups: within distance
d, of d + j groups at least j stay equal, so each choice of j groups is a table
whose cells hold all pairs that the bound allows.  For large ones groups are
sampled.  In a cell the Manhattan distance over all coordinates drops most pairs,
and the Hamming distance of the whole fingerprints decides.

Equal fingerprints are one point, however many documents have it.  Points go to
cells by whole-number expressions on the fingerprint's words, and one shuffle
brings a cell's points together, in order.  A cell gives a spanning forest of
its links and not its pairs, each tree grown from a point in the middle of its
neighbours, which most tables choose alike, so they name few edges between them.  A cell of more than ``cell_points`` is
only counted there; its points then come again, dealt into chunks, and each pair
of chunks is compared in a task of its own.  A pair of chunks names only edges
that join what either chunk has apart, so the edges of a large group grow with
its points and not with its pairs of chunks.

Near copies by the similarity of shingle sets take the grid's components as
candidates and compare the sets themselves within each (``near``).

Connected components come by alternating stars, from links alone, with every
round's edges written to the shared folder and the last round's deleted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SALTS = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, repeats included; a shorter text is one shingle, one without words none."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([h(joined, 42)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: len(ends) - words])]
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :], strict=True)), np.uint64, len(starts))


def widen(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits / 64) words: the hashes and mixes of them."""
    out = np.empty((len(hashes), bits // 64), np.uint64)
    out[:, 0] = hashes
    for k in range(1, bits // 64):
        z = hashes + _SALTS[k]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def fingerprint(text: bytes | None, words: int = 3, bits: int = 64) -> bytes:
    """Big-endian fingerprint: a bit is 1 where over half the shingles' hashes have it."""
    return folded(shingle_hashes(text, words), bits)


def folded(hashes: np.ndarray, bits: int) -> bytes:
    """The fingerprint of some hashes."""
    if not len(hashes):
        return bytes(bits // 8)
    ones = np.zeros(bits, np.int64)
    for k in range(0, len(hashes), 4096):
        part = widen(hashes[k : k + 4096], bits).astype(">u8").view(np.uint8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3, bits: int = 64) -> DataFrame:
    """(id, fp): the binary fingerprint of each row's whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(0, b.num_rows, 500):
                s = b.slice(k, 500)
                fps = [fingerprint(t, words, bits) for t in s.column(1).cast(pa.binary()).to_pylist()]
                yield pa.record_batch([s.column(0), pa.array(fps, pa.binary())], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp binary")


def pigeonhole(bits: int, distance: int, equal: int, segment: int = 2) -> list[list[int]]:
    """Tables that miss no pair: the segments of each choice of ``equal`` of ``distance + equal`` groups."""
    groups = np.array_split(np.arange(bits // segment), distance + equal)
    return [np.concatenate([groups[g] for g in choice]).tolist() for choice in combinations(range(distance + equal), equal)]


def exact_tables(points: int, bits: int, distance: int, segment: int = 2, cell_points: int = 64) -> list[list[int]]:
    """The pigeonhole whose cells hold some ``cell_points`` of so many points: more groups stay equal as the points grow."""
    per_segment = {1: 1.0, 2: 1.415}[segment]  # fewest bits that tell two counts apart, of binomial ones
    equal = 2
    while points / cell_points > 2 ** (per_segment * (bits // segment) * equal / (distance + equal)) and equal < bits // segment - distance:
        equal += 1
    return pigeonhole(bits, distance, equal, segment)


def sampled(bits: int, tables: int, coordinates: int, segment: int = 2, seed: int = 1) -> list[list[int]]:
    """Tables of ``coordinates`` random segments each, for distances that a pigeonhole doesn't reach."""
    rng = np.random.default_rng(seed)
    return [sorted(rng.choice(bits // segment, coordinates, replace=False).tolist()) for _ in range(tables)]


def segment_counts(fps: np.ndarray, segment: int = 2) -> np.ndarray:
    """(n, bytes) uint8 to (n, segments) counts of ones."""
    n, width = fps.shape
    return np.unpackbits(fps, axis=1).reshape(n, width * 8 // segment, segment).sum(axis=2, dtype=np.int8)


_PAIRS = np.uint64(0x5555555555555555)


def embed(words: np.ndarray, segment: int) -> np.ndarray:
    """Counts of ones by segment, packed into the words' own bits: the bit itself, or the sum of two neighbours."""
    return words if segment == 1 else (words & _PAIRS) + ((words >> np.uint64(1)) & _PAIRS)


def manhattan(a: np.ndarray, b: np.ndarray, segment: int) -> np.ndarray:
    """Sum over segments of the difference of packed counts."""
    if segment == 1:
        return np.bitwise_count(a ^ b).astype(np.int16)
    # two-bit fields of 0..2: they differ by 2 where the high bits do and the low ones are both clear
    x = a ^ b
    low, high = x & _PAIRS, (x >> np.uint64(1)) & _PAIRS
    return np.bitwise_count(low).astype(np.int16) + 2 * np.bitwise_count(high & ~low & _PAIRS).astype(np.int16)


def masks(table: list[int], bits: int, segment: int) -> list[int]:
    """The table's segments as bits of each 64-bit word, as signed numbers."""
    out = [0] * (bits // 64)
    for s in table:
        for bit in range(s * segment, (s + 1) * segment):
            out[bit // 64] |= 1 << (63 - bit % 64)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def joining(n: int, known: list[tuple[int, int]], edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``edges``, in turn, that join points which ``known`` ones and the edges before leave apart."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for some, new in ((known, False), (edges, True)):
        for edge in some:
            a, b = find(edge[0]), find(edge[1])
            if a != b:
                up[b] = a
                if new:
                    out.append(edge)
    return out


def forest(words: np.ndarray, distance: int, segment: int = 2, chunks: np.ndarray | None = None, block: int = 256) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among some distinct fingerprints, given as (n, words) numbers.

    A tree grows from the point nearest to the bitwise majority of its first
    point's neighbours: of a group of near copies mostly the same one, whichever
    of them a cell holds.  Where the points are of two ``chunks``, the edges are
    those between what each chunk links by itself.
    """
    n, counts = len(words), embed(words, segment)
    close = np.zeros((n, n), bool)
    for i in range(0, n, block):
        near = np.zeros((min(block, n - i), n - i), np.int16)
        for w in counts.T:
            near += manhattan(w[i : i + block, None], w[None, i:], segment)
        near = near <= distance
        if segment > 1:
            a, b = np.nonzero(near)
            near[a, b] = np.bitwise_count(words[i + a] ^ words[i + b]).sum(axis=1) <= distance
        close[i : i + block, i:] |= near
        close[i:, i : i + block] |= near.T
    edges = _trees(close, words)
    if chunks is None or (chunks == chunks[0]).all() or not edges:
        return edges
    return joining(n, _trees(close & (chunks[:, None] == chunks), words), edges)


def _trees(close: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
    left, edges = close.sum(axis=1) > 1, []
    while left.any():
        around = np.flatnonzero(close[left.argmax()] & left)
        bits = np.unpackbits(np.ascontiguousarray(words[around]).view(np.uint8).reshape(len(around), -1), axis=1)
        middle = 2 * bits.sum(axis=0, dtype=np.int32) > len(around)
        queue = [int(around[(bits != middle).sum(axis=1).argmin()])]
        left[queue] = False
        while queue:
            at = queue.pop()
            found = np.flatnonzero(close[at] & left).tolist()
            left[found] = False
            edges += [(at, x) for x in found]
            queue += found
    return edges


def _near(words: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int, segment: int) -> np.ndarray:
    """Which of some pairs link: first by the Manhattan bound, then by the Hamming distance."""
    counts = embed(words, segment)
    near = np.flatnonzero(sum(manhattan(w[i], w[j], segment) for w in counts.T) <= distance)
    if segment > 1:
        near = near[np.bitwise_count(words[i[near]] ^ words[j[near]]).sum(axis=1) <= distance]
    return near


def _edges(keys: np.ndarray, chunks: np.ndarray | None, words: np.ndarray, distance: int, segment: int, cell_points: int) -> tuple[list[np.ndarray], list[np.ndarray], list[tuple[int, int]]]:
    """Links within runs of equal keys, and the keys and sizes of the runs of over ``cell_points``, which are not searched."""
    starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
    sizes = np.diff(np.append(starts, len(keys)))
    a, b, large = [], [], []
    few = starts[(sizes == 2) | (sizes == 3)]
    three = starts[sizes == 3]
    i, j = np.concatenate([few, three, three]), np.concatenate([few + 1, three + 2, three + 1])
    i[len(few) + len(three) :] += 2  # the third pair of three is (third, second)
    if len(i):
        near = _near(words, i, j, distance, segment)
        a.append(i[near])
        b.append(j[near])
    for s, n in zip(starts[sizes > 3].tolist(), sizes[sizes > 3].tolist(), strict=True):
        if n > cell_points:
            large.append((s, n))
        elif found := forest(words[s : s + n], distance, segment, None if chunks is None else chunks[s : s + n]):
            x = np.array(found)
            a.append(s + x[:, 0])
            b.append(s + x[:, 1])
    return a, b, large


def _searcher(n_keys: int, width: int, distance: int, segment: int, cell_points: int):
    """A function over batches of sorted rows (keys..., words...), with the point's chunk last in the keys where there are several: edges (a, b), and (cell, n) of cells of more points than are held."""

    def batch(words: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], large: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        none, no_edge = [None] * len(a), [None] * len(large)
        packed = [np.ascontiguousarray(words[x]).astype(">u8").view(f"V{8 * width}").ravel().tolist() for x in (a, b)]
        cells = [none + [c for c, _ in large], none + [n for _, n in large]]
        return pa.record_batch([*(pa.array(x + no_edge, pa.binary()) for x in packed), *(pa.array(x, pa.int64()) for x in cells)], names=["a", "b", "cell", "n"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words = np.zeros((0, n_keys), np.int64), np.zeros((0, width), np.uint64)
        skipped: list = []  # the cell that is only counted, and its points so far

        def work(whole: int) -> pa.RecordBatch:
            own, chunks = (keys[:whole, :-1], keys[:whole, -1]) if n_keys > 1 else (keys[:whole], None)
            a, b, large = _edges(own, chunks, words[:whole], distance, segment, cell_points)
            return batch(words[:whole], a, b, [(int(keys[s, 0]), n) for s, n in large])

        for part in it:
            columns = [c.to_numpy() for c in part.columns]
            more, more_words = np.stack(columns[:n_keys], axis=1), np.stack(columns[n_keys:], axis=1).view(np.uint64)
            if skipped:
                run_on = int((more[:, 0] == skipped[0]).sum())  # sorted, so they stand first
                skipped[1] += run_on
                if run_on == len(more):
                    continue
                yield batch(words[:0], [], [], [tuple(skipped)])
                skipped, more, more_words = [], more[run_on:], more_words[run_on:]
            keys, words = np.concatenate([keys, more]), np.concatenate([words, more_words])
            if len(keys) < 4096:
                continue
            own = keys[:, : max(1, n_keys - 1)]
            last = len(keys) - int((own == own[-1]).all(axis=1).sum())
            if last:
                yield work(last)
                keys, words = keys[last:], words[last:]
            if len(keys) > cell_points:
                skipped = [int(keys[0, 0]), len(keys)]
                keys, words = keys[:0], words[:0]
        if skipped:
            yield batch(words[:0], [], [], [tuple(skipped)])
        if len(keys):
            yield work(len(keys))

    return run


def links(fps: DataFrame, bits: int, distance: int, tables: list[list[int]], segment: int = 2, cell_points: int = 4096) -> DataFrame:
    """(a, b), stored: edges that connect exactly the fingerprints whose links some cell holds.  ``fps`` has distinct ``fp``."""
    width, every = bits // 64, [masks(t, bits, segment) for t in tables]
    names = [f"w{k}" for k in range(width)]
    # big-endian words by way of hexadecimal: two halves of 32 bits each, as no function reads a signed 64-bit number
    half = lambda k: F.conv(F.hex(F.substring("fp", 4 * k + 1, 4)), 16, 10).cast("long")
    points = fps.select(*[F.shiftleft(half(2 * k), 32).bitwiseOR(half(2 * k + 1)).alias(n) for k, n in enumerate(names)])
    low = F.lit(0x5555555555555555)

    def cell(table: Column) -> Column:
        """A hash of the table and the packed counts of its segments; two cells that share one are searched together, which loses nothing."""
        chosen = [F.get(F.array(*[F.lit(m[k]) for m in every]), table) for k in range(width)]
        even, odd = ([x.bitwiseAND(low) for x in y] for y in (map(F.col, names), [F.shiftrightunsigned(n, 1) for n in names]))
        # sums of two bits, without a carry that could overflow
        packed = [F.col(n) if segment == 1 else a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1)) for n, a, b in zip(names, even, odd, strict=True)]
        return F.xxhash64(table, *[p.bitwiseAND(m) for p, m in zip(packed, chosen, strict=True)])

    dealt = points.select(F.explode(F.sequence(F.lit(0), F.lit(len(tables) - 1))).alias("t"), *names)
    # the cell is computed again after the shuffle rather than sent
    first = dealt.repartition(cell(F.col("t"))).select(cell(F.col("t")).alias("cell"), *names).sortWithinPartitions("cell", *names)
    kind = "a binary, b binary, cell long, n long"
    found = common.stored(first.mapInArrow(_searcher(1, width, distance, segment, cell_points), kind), "cells")
    edges = found.where("a is not null").select("a", "b")
    crowded = found.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n"))
    rest = None
    if not crowded.isEmpty():
        k = F.ceil(F.col("n") / (cell_points // 2)).cast("int")
        chunk = F.pmod(F.xxhash64(*names), k).cast("int")
        rows = dealt.select(cell(F.col("t")).alias("cell"), *names).join(crowded, "cell").select("cell", *names, chunk.alias("c"), F.explode(F.sequence(F.lit(0), k - 1)).alias("j"))
        rows = rows.select("cell", F.least("c", "j").cast("long").alias("i"), F.greatest("c", "j").cast("long").alias("j"), F.col("c").cast("long").alias("c"), *names).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "c", *names)
        # two chunks hold some cell_points; where the hash deals one more, they are searched all the same
        rest = common.stored(rows.mapInArrow(_searcher(4, width, distance, segment, 1 << 62), kind), "crowded")
        edges = edges.unionByName(rest.select("a", "b"))
    out = common.stored(edges.distinct(), "links")
    common.drop(found, *([rest] if rest else []))
    return out


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each linked node's component, by alternating large and small stars.

    Edges alone are kept, one row for each.  At first every node hooks to its
    least neighbour, and edges move to the nodes hooked to: where many tables
    name edges between the same points, few are left.  The least neighbours are written
    before they are joined, so both sides of a star's join come straight from an
    exchange and the adaptive planner can split a hub's edges over tasks.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges, before = common.stored(edges, "edges"), None
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = common.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    half = common.stored(edges.join(least, "u").select(F.col("m").alias("x"), "v").distinct(), "half")
    moved = half.join(least.select(F.col("u").alias("v"), F.col("m").alias("y")), "v").where("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    last, edges = edges, common.stored(moved.unionByName(least.where("u != m").select("u", F.col("m").alias("v"))).distinct(), "edges")
    common.drop(last, least, half)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # every neighbour above the node goes to the least node of its star
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = common.stored(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large")
        down = common.stored(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, common.stored(small, "edges")
        common.drop(last, least, large, down)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    out = common.stored(out, "components")
    common.drop(edges)
    return out


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 64, distance: int = 3, tables: list[list[int]] | None = None) -> DataFrame:
    """(id, fingerprint, component_id) for every row.

    ``fingerprint`` is hexadecimal; ``component_id`` the smallest id among the
    rows that links reach, the row's own included.  Texts without words, null
    ones too, have fingerprint zero and so link to each other.  A row with a null
    id belongs to its component without naming it; one of null ids alone has a
    null component.  Rows that repeat an id are rows of their own.  Without
    ``tables`` the grid misses no pair within ``distance``, and has as many
    tables as the number of fingerprints needs.
    """
    found = common.stored(fingerprints(docs, id_col, text_col, words, bits), "fingerprints")
    distinct = common.stored(found.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    tables = exact_tables(distinct.count(), bits, distance) if tables is None else tables
    edges = links(distinct, bits, distance, tables)
    labels = components(edges)
    by_fp = common.stored(distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "labelled")
    # written, so that the joins below have a plain exchange on either side and a large component or a hot fingerprint can be split
    least = common.stored(by_fp.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    named = common.stored(by_fp.join(least, "label").select("fp", "component_id"), "named")
    common.drop(distinct, edges, labels, by_fp, least)
    return found.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: Five-word shingles and a Jaccard similarity of 4/5.  The fingerprints only find candidates: at that similarity 15 % of the bits differ, and 19 % of the shortest texts', so beyond ``distance`` of 192 are less than one pair in 10,000.
NEAR = {"words": 5, "bits": 192, "distance": 58, "similarity": (4, 5)}
#: Rows of ids and digests that are sent to every executor rather than joined by a shuffle: some 32 MB.
SENT_ROWS = 250_000


def grid_misses(differs: float, coordinates: int, tables: int, bits: int = NEAR["bits"], distance: int = NEAR["distance"]) -> float:
    """How likely a pair whose bits differ with a probability is to share no cell, or to be beyond ``distance``; tables share a pair's bits, so it goes by the bits that differ."""
    n, all_misses = math.comb(bits, coordinates), 0.0
    for d in range(bits + 1):
        law = math.comb(bits, d) * differs**d * (1 - differs) ** (bits - d)
        all_misses += law * ((1 - math.comb(bits - d, coordinates) / n) ** tables if d <= distance else 1)
    return all_misses


def near_tables(points: int, cell_points: int = 2048) -> list[list[int]]:
    """Tables of one-bit segments for the sampled grid over some points.

    A cell holds ``cell_points`` or fewer, and there are as many tables as miss
    no more than one in 10,000 of the pairs at a similarity of 0.8 whose bits
    differ most (16.2 %; one of the kind of four and five shingles, 19 %, is
    missed once in 1,000 or so).
    """
    coordinates, tables = max(8, math.ceil(math.log2(max(points, 1) / cell_points))), 16
    while grid_misses(0.1615, coordinates, tables) > 1e-4:
        tables += max(4, tables // 32)
    return sampled(NEAR["bits"], tables, coordinates, segment=1)


def digest(text: Column) -> Column:
    """MD5 of a text's bytes, a null one's being the empty text's."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int) -> DataFrame:
    """(id, key, fp, size): digest and bytes of each text, and the fingerprint of its set of shingles."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(0, b.num_rows, 500):
                s = b.slice(k, 500)
                texts = [t or b"" for t in s.column(1).cast(pa.binary()).to_pylist()]
                fps = [folded(np.unique(shingle_hashes(t, words)), bits) for t in texts]
                keys = [hashlib.md5(t, usedforsecurity=False).digest() for t in texts]
                yield pa.record_batch([s.column(0), pa.array(keys, pa.binary()), pa.array(fps, pa.binary()), pa.array(map(len, texts), pa.int64())], names=["id", "key", "fp", "size"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, key binary, fp binary, size long")


def prefix_edges(docs: DataFrame, text_col: str, words: int, similarity: tuple[int, int]) -> DataFrame:
    """(a, b), stored: edges between keys of texts, whose components hold every pair of the similarity: the exact candidates.

    Of n shingles in the order of their hashes, two texts of a similarity s share
    one among each one's first n - ceil(s n) + 1.  Texts that share such a shingle
    are joined to the least of them, so a common shingle gives a star.
    """
    num, den = similarity

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(0, b.num_rows, 200):
                keys, shingles = [], []
                for t in b.column(0).slice(k, 200).cast(pa.binary()).to_pylist():
                    own = np.unique(shingle_hashes(t, words))
                    first = own[: len(own) - (num * len(own) + den - 1) // den + 1] if len(own) else np.zeros(1, np.uint64)  # texts without words are alike
                    keys += [hashlib.md5(t or b"", usedforsecurity=False).digest()] * len(first)
                    shingles.append(first.view(np.int64))
                yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(np.concatenate([np.zeros(0, np.int64), *shingles]))], names=["key", "shingle"])

    held = common.stored(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key binary, shingle long").distinct(), "prefixes")
    least = common.stored(held.groupBy("shingle").agg(F.min("key").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
    out = common.stored(held.join(least, "shingle").where("key != b").select(F.col("key").alias("a"), "b").distinct(), "links")
    common.drop(held, least)
    return out


def alike(sets: list[np.ndarray], similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of sets whose Jaccard similarity is the fraction ``similarity`` or more."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]
    at_value = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(values)))])
    at_set = np.concatenate([[0], np.cumsum(sizes)])
    left, edges, queue = np.arange(n), [], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        own = ids[at_set[at] : at_set[at + 1]]
        lens = at_value[own + 1] - at_value[own]
        spots = np.repeat(at_value[own] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
        shared = np.bincount(holders[spots], minlength=n)[left]
        some = shared * similarity[1] >= similarity[0] * (sizes[at] + sizes[left] - shared)
        found = left[some].tolist()
        edges += [(at, x) for x in found]
        queue += found
        left = left[~some]
    return edges


def same(texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): keys of texts that are alike by their exact shingle sets, one edge for each that joins two groups.

    ``texts`` has label, i, j, c, key and text; those of a (label, i, j) are
    compared, and of two chunks ``c`` only what joins groups of both is named.
    """

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, sets, chunks = None, [], [], []

        def edges() -> pa.RecordBatch:
            found = alike(sets, similarity) if len(sets) > 1 else []
            if found and chunks[0] != chunks[-1]:  # in order, so the first chunk's texts come first
                m = chunks.index(chunks[-1])
                found = joining(len(sets), alike(sets[:m], similarity) + [(a + m, b + m) for a, b in alike(sets[m:], similarity)], found)
            return pa.record_batch([pa.array([keys[e[x]] for e in found], pa.binary()) for x in (0, 1)], names=["a", "b"])

        for b in it:
            for *of, chunk, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != group:
                    yield edges()
                    group, keys, sets, chunks = of, [], [], []
                elif key == keys[-1]:
                    continue  # rows that repeat an id and a text
                keys.append(key)
                chunks.append(chunk)
                sets.append(np.unique(shingle_hashes((text or "").encode("utf-8", "surrogatepass"), words)))
        yield edges()

    rows = texts.select("label", "i", "j", "c", "key", "text").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "c", "key")
    return rows.mapInArrow(search, "a binary, b binary").distinct()


def _by_key(big: DataFrame, slim: DataFrame, how: str) -> DataFrame:
    """``big`` joined with the rows of ``slim`` that have its id and key; a stored ``slim`` of few rows is sent, a larger one shuffled."""
    if slim.count() <= SENT_ROWS:
        slim = F.broadcast(slim)
    return big.join(slim, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i")), how)


def near(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int, distance: int, similarity: tuple[int, int], tables: list[list[int]] | None = None, chunk_texts: int = 1024, chunk_bytes: int = 16 << 20, exact: bool = False) -> DataFrame:
    """(id, key, first_id, first_key) for every row, stored, by links between texts whose shingle sets have a Jaccard ``similarity`` or more.

    ``key`` is the text's digest; rows of one text are one point.  Components of
    the grid's links within ``distance`` are the candidates; within each, all
    pairs are compared by their shingles, and only the pairs that are alike link.
    A component of more than ``chunk_texts`` or ``chunk_bytes`` is dealt into
    chunks, and each pair of chunks is compared in a task of its own.  Where
    ``exact``, candidates come of shared shingles instead and no pair is missed;
    passages that many texts share then make large components.  A group's first row is that with the smallest id, null ids last, then the smallest key.
    """
    found = common.stored(sketches(docs, id_col, text_col, words, bits), "sketches")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first")
    distinct = common.stored(found.groupBy("key").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), first).select("key", "fp", "size", F.col("first.id").alias("id")), "distinct")
    point = "key" if exact else "fp"
    points = common.stored(distinct.select(point).distinct(), "points")
    if exact:
        edges = prefix_edges(docs, text_col, words, similarity)
    else:
        edges = links(points, bits, distance, near_tables(points.count()) if tables is None else tables, segment=1)
    grid = components(edges)
    placed = common.stored(distinct.join(grid, distinct[point] == grid["node"], "left").select("key", "id", "size", F.coalesce("label", point).alias("label")), "placed")
    common.drop(points, edges, grid)
    crowd = common.stored(placed.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1"), "crowd")
    k = F.greatest(F.ceil(F.col("n") / chunk_texts), F.ceil(F.col("bytes") / chunk_bytes)).cast("int")
    dealt = placed.join(crowd, "label").select(F.col("id").alias("_i"), F.col("key").alias("_k"), "label", F.pmod(F.xxhash64("key"), k).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), k - 1)).alias("j"))
    dealt = common.stored(dealt.select("_i", "_k", "label", F.least("c", "j").alias("i"), F.greatest("c", "j").alias("j"), "c"), "candidates")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("_key", digest(F.col("text")))
    pairs = common.stored(same(_by_key(texts, dealt, "inner").withColumn("key", F.col("_key")), words, similarity), "pairs")
    labels = components(pairs)
    by_key = common.stored(distinct.join(labels, distinct["key"] == labels["node"], "left").select("key", "id", F.coalesce("label", "key").alias("label")), "labelled")
    least = by_key.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    least = common.stored(least.select("label", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key")), "least")
    named = common.stored(by_key.join(least, "label").select("key", "first_id", "first_key"), "named")
    out = common.stored(found.select("id", "key").join(named, "key"), "groups")
    common.drop(found, distinct, placed, crowd, dealt, pairs, labels, by_key, least, named)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The first row of each group of ``docs``, with all its columns: that of the smallest id.

    A null id comes after all others; of rows that repeat an id the one with the
    smallest digest of its text is first, and of rows that repeat both one stays.
    An empty table stays empty.
    """
    groups = near(docs, id_col, text_col, **{**NEAR, **more})
    own = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key"))
    gone = common.stored(groups.where(~own).select(F.col("id").alias("_i"), F.col("key").alias("_k")).distinct(), "gone")
    twice = common.stored(groups.where(own).groupBy(F.col("id").alias("_i"), F.col("key").alias("_k")).count().where("count > 1").drop("count"), "twice")
    common.drop(groups)
    # rows go into a struct, so their columns may have any names
    rows = docs.select(F.struct("*").alias("_row"), F.col(f"`{id_col}`").alias("_id"), digest(F.col(f"`{text_col}`")).alias("_key"))
    kept = _by_key(rows, gone, "left_anti")
    if not twice.isEmpty():
        kept = _by_key(kept, twice, "left_anti").unionByName(_by_key(kept, twice, "left_semi").dropDuplicates(["_id", "_key"]))
    return kept.select("_row.*")
