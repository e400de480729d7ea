"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the word windows of the benchmark items: ``window`` consecutive
words, or the whole item where it has fewer.  Texts are searched as sequences of
word numbers, number 0 being any word that no pattern has.

For patterns of one length m and blocks of b words (two, or one where m is below
three) a table by block hash has the block's shift: how far the search may move
on from a place where the block ends the m words, m - b + 1 where no pattern has
the block and 0 where some pattern ends with it.  Only words at the places the
search stops at are looked up.  At shift 0 the suffix block's hash selects the
bucket of patterns that end so, the hash of all m words those of them to test,
and the words themselves are compared.

The patterns come to the driver in batches whose bytes are bounded by
``batch_bytes``; each batch is a broadcast of its own.  Up to ``chained`` batches
are searched in one pass over the texts, each adding its hits to the row it
reads; then the rows are written, the batches released, and the next pass begins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes to lower case, and every ASCII character that is no letter or digit to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of item texts in a batch: some 0.7 million windows, which take about 0.2 GB while the tables are built and 0.1 GB when sent.
BATCH_BYTES = 4 << 20
#: Batches in one pass over the texts: as many Python workers follow each other in a task.
CHAINED = 4


def words_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).translate(_FOLD).split()


def _hash(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word numbers."""
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = (h ^ rows[:, k].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


#: Factor of the first word's number in a block's hash.
_BLOCK = 0x9E3779B1


class Patterns:
    """All windows of some items, ready to be searched for."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = 10):
        self.ids: list[str] = []
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            k = len(self.ids)
            self.ids.append(name)
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            m = min(window, len(numbers))
            for i in range(len(numbers) - m + 1):
                own = by_length[m][tuple(numbers[i : i + m])]
                if not own or own[-1] != k:
                    own.append(k)
        self.groups = [self._group(m, found) for m, found in sorted(by_length.items())]

    @staticmethod
    def _group(m: int, found: dict[tuple[int, ...], list[int]]) -> dict:
        rows = np.array(list(found), np.int64).reshape(-1, m)
        block = 2 if m >= 3 else 1
        bits = max(10, (4 * len(rows) * (m - block + 1)).bit_length())
        mask = (1 << min(bits, 24)) - 1
        shifts = np.full(mask + 1, m - block + 1, np.uint8 if m < 256 else np.uint32)
        for j in range(m - block + 1):  # from the largest shift to 0, so a block keeps its smallest
            ends = (rows[:, j] * _BLOCK + rows[:, j + 1] if block == 2 else rows[:, j]) & mask
            shifts[ends] = m - block - j
        hashes = _hash(rows)
        order = np.lexsort((hashes, ends))
        rows, hashes, ends, owners = rows[order], hashes[order], ends[order], list(found.values())
        suffixes, first = np.unique(ends, return_index=True)
        return {
            "m": m, "block": block, "mask": mask, "shifts": shifts.tobytes() if m < 256 else shifts.tolist(), "rows": rows, "hashes": hashes,
            "owners": [owners[i] for i in order.tolist()], "suffixes": suffixes, "bounds": np.append(first, len(rows)),
        }

    def search(self, words: list[bytes]) -> list[tuple[int, int, list[int]]]:
        """(start, length, items) of every occurrence in one text's words."""
        out: list[tuple[int, int, list[int]]] = []
        get, n = self.vocabulary.get, len(words)
        for g in self.groups:
            m, mask, shifts, two = g["m"], g["mask"], g["shifts"], g["block"] == 2
            most, end = m - g["block"] + 1, m
            while end <= n:
                if not (last := get(words[end - 1], 0)):
                    end += m  # no pattern has the word, so none spans it
                    continue
                if two:
                    if not (before := get(words[end - 2], 0)):
                        end += most
                        continue
                    h = (before * _BLOCK + last) & mask
                else:
                    h = last & mask
                if shift := shifts[h]:
                    end += shift
                    continue
                k = int(np.searchsorted(g["suffixes"], h))
                if k < len(g["suffixes"]) and g["suffixes"][k] == h:
                    got = np.array([[get(w, 0) for w in words[end - m : end]]], np.int64)
                    low, high, whole = g["bounds"][k], g["bounds"][k + 1], _hash(got)[0]
                    p = low + int(np.searchsorted(g["hashes"][low:high], whole))
                    while p < high and g["hashes"][p] == whole:
                        if np.array_equal(g["rows"][p], got[0]):
                            out.append((end - m, m, g["owners"][p]))
                        p += 1
                end += 1
        return out


_FOUND = pa.schema([("row_key", pa.string()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _apart(pairs: list[tuple[int, int]]) -> list[int]:
    """Starts and ends in turn of the union of some ranges, ascending and apart."""
    flat: list[int] = []
    for a, b in sorted(pairs):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def _scan(patterns: Patterns, batch: pa.RecordBatch, last: bool) -> pa.RecordBatch:
    """The batch with what these patterns hit added to its spans and items; after the last patterns the text goes."""
    n_words, all_spans, all_items = [], [], []
    for text, spans, items in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
        words = words_of(text)
        found = patterns.search(words)
        n_words.append(len(words))
        all_spans.append(_apart([*zip(spans[::2], spans[1::2], strict=True), *((s, s + m) for s, m, _ in found)]) if found else spans)
        all_items.append(sorted({*items, *(patterns.ids[i] for _, _, owners in found for i in owners)}) if found else items)
    text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column(1)
    return pa.record_batch([batch.column(0), text, pa.array(n_words, pa.int64()), pa.array(all_spans, _FOUND.field("spans").type), pa.array(all_items, _FOUND.field("items").type)], schema=_FOUND)


def batch_filters(items: DataFrame, id_col: str, text_col: str, batch_bytes: int) -> Iterator[DataFrame]:
    """The items as (id, text), dealt by hash into frames of about ``batch_bytes`` of text."""
    light = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    n = -(-(light.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // batch_bytes) or 1
    for k in range(n):
        yield light if n == 1 else light.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)


def _passes(out: DataFrame, items: DataFrame, item_id: str, item_text: str, window: int, batch_bytes: int, chained: int, add) -> DataFrame:
    """``out`` after the search for all batches: ``add(frame, sent, last)`` chains one, and after ``chained`` the rows are written and the batches released."""
    spark, sent, stored = out.sparkSession, [], None
    parts = list(batch_filters(items, item_id, item_text, batch_bytes))
    for k, part in enumerate(parts):
        sent.append(spark.sparkContext.broadcast(Patterns([(r["id"], r["text"]) for r in part.collect()], window)))
        out = add(out, sent[-1], k == len(parts) - 1)
        if len(sent) == chained and k < len(parts) - 1:
            before, out = stored, common.stored(out, "decontaminate")
            stored = out
            common.drop(*([before] if before is not None else []))
            for x in sent:
                x.destroy()
            sent = []
    return out


def search(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, window: int = 10, batch_bytes: int = BATCH_BYTES, chained: int = CHAINED) -> DataFrame:
    """Per row of ``docs``: ``row_key`` (its id as text), ``n_words``, ``spans`` and ``items``.

    ``spans`` lists starts and ends (exclusive) of the hit words in turn, apart
    and ascending; ``items`` the sorted ids of the items found.  Rows that repeat
    an id are searched each; null texts and texts without words give no span.
    Items without words match nothing; equal items are all named; a null item id
    reads as the empty text.
    """
    out = docs.select(
        F.col(id_col).cast("string").alias("row_key"), F.col(text_col).cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )

    def add(out: DataFrame, sent, last: bool) -> DataFrame:
        def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns = sent.value
            for b in it:
                for i in range(0, b.num_rows, 500):
                    yield _scan(patterns, b.slice(i, 500), last)

        return out.mapInArrow(scan, "row_key string, text string, n_words long, spans array<bigint>, items array<string>")

    return _passes(out, items, item_id, item_text, window, batch_bytes, chained, add).drop("text")


def n_hit():
    """Words within the spans."""
    pairs = F.sequence(F.lit(0), F.floor(F.size("spans") / 2) - 1)
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, i: acc + F.get(F.col("spans"), (i * 2 + 1).cast("int")) - F.get(F.col("spans"), (i * 2).cast("int")))
    return F.when(F.size("spans") == 0, F.lit(0).cast("long")).otherwise(total)


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", **more) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    kind = docs.schema[id_col].dataType
    found = search(docs, id_col, text_col, items, item_id, item_text, **more)
    return found.select(
        F.col("row_key").cast(kind).alias(id_col),
        "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, batch_bytes: int = BATCH_BYTES, chained: int = CHAINED) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with their columns as they are.

    Narrow passes; no key is needed, so nulls and repeated ids are kept apart.
    An empty ``items`` keeps every row.
    """
    schema, at = docs.schema, docs.columns.index(text_col)

    def add(out: DataFrame, sent, last: bool) -> DataFrame:
        def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns = sent.value
            for b in it:
                for k in range(0, b.num_rows, 500):
                    s = b.slice(k, 500)
                    yield s.filter(pa.array([not patterns.search(words_of(t)) for t in s.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))

        return out.mapInArrow(scan, schema)

    return _passes(docs, items, item_id, item_text, window, batch_bytes, chained, add)
