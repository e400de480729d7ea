"""Splitting of texts by size and by meaning, and the edges between the pieces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone import schema as S
from quernstone.config import SplitterConfig
from quernstone.functions import text as TX
from quernstone.functions import vectors as V

_PHRASE = re.compile(TX.PHRASE)


def split_recursive(text: str, size: int, tokenizer: TX.Tokenizer, config: SplitterConfig = SplitterConfig()) -> list[tuple[str, int]]:
    """(piece, tokens): paragraphs, then phrases, then words, going down only where a piece is too large.

    A piece without any boundary inside stays whole, however long it is.
    """
    out: list[tuple[str, int]] = []
    todo = [text]
    while todo:
        piece = todo.pop()
        n = tokenizer.count(piece)
        if n <= size:
            out.append((piece, n))
            continue
        for separator in (config.paragraph_separator, None, config.word_separator):
            parts = _PHRASE.findall(piece) if separator is None else piece.split(separator)
            if separator and config.preserve_separators:
                parts = [p + separator for p in parts[:-1]] + parts[-1:]
            parts = [p for p in parts if p]
            if len(parts) > 1:
                todo.extend(reversed(parts))
                break
        else:
            out.append((piece, n))
    return out


def merge_pieces(pieces: list[tuple[str, int]], size: int, overlap: int) -> list[tuple[str, int]]:
    """Joins neighbours greedily up to ``size``; each chunk begins with the longest run of the last one's pieces within ``overlap``.

    What is carried over isn't counted out again, so a chunk can exceed ``size``
    by the overlap.
    """
    chunks: list[tuple[str, int]] = []
    held: list[tuple[str, int]] = []
    total = 0
    for piece in pieces:
        if held and total + piece[1] > size:
            chunks.append(("".join(p for p, _ in held), total))
            kept, carried = 0, []
            for old in reversed(held):
                if kept + old[1] > overlap:
                    break
                kept += old[1]
                carried.insert(0, old)
            held, total = carried, kept
        held.append(piece)
        total += piece[1]
    if held:
        chunks.append(("".join(p for p, _ in held), total))
    return chunks


def sentence_chunks(nodes: DataFrame, config: SplitterConfig = SplitterConfig(), tokenizer: TX.Tokenizer | None = None) -> DataFrame:
    """Nodes split into chunks of at most the configured tokens, less those of their metadata as an embedder sees it.

    A node whose metadata leaves no room, or that isn't text, passes as it is.
    Chunks inherit metadata and exclude-lists, keep their token counts, and name
    their source in ``ref_doc_id`` and their place in ``ord``.
    """
    tok = tokenizer or TX.RegexTokenizer()

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("n_tokens", pa.int32())]))
        for b in it:
            for k in range(0, b.num_rows, 200):
                s = b.slice(k, 200)
                out = []
                for text, meta, is_text in zip(s.column("_text").to_pylist(), s.column("_meta").to_pylist(), s.column("_is_text").to_pylist(), strict=True):
                    room = config.chunk_size - tok.count(meta or "")
                    if not is_text or text is None or room <= 0:
                        out.append(None)
                    else:
                        chunks = merge_pieces(split_recursive(text, room, tok, config), room, config.chunk_overlap)
                        out.append([{"text": t, "n_tokens": n} for t, n in chunks])
                yield pa.record_batch([s.column("_row"), pa.array(out, kind)], names=["_row", "_chunks"])

    keyed = nodes.withColumn("_row", F.struct("node_id", "node_hash"))
    distinct = keyed.dropDuplicates(["node_id", "node_hash"]).select(
        F.col("_row"), F.col("text").alias("_text"), S.render_metadata(F.col("metadata"), F.col("excl_embed")).alias("_meta"), (F.col("kind") == S.TEXT).alias("_is_text")
    )
    pieces = distinct.mapInArrow(split, "_row struct<node_id:string,node_hash:string>, _chunks array<struct<text:string,n_tokens:int>>")
    rows = keyed.join(pieces, "_row").select(*nodes.columns, F.posexplode_outer("_chunks").alias("_at", "_chunk"))
    whole = F.col("_chunk").isNull()
    made = rows.withColumn("ref_doc_id", F.when(whole, F.col("ref_doc_id")).otherwise(F.col("node_id"))).withColumn("ord", F.when(whole, F.col("ord")).otherwise(F.col("_at")))
    made = made.withColumn("text", F.when(whole, F.col("text")).otherwise(F.col("_chunk.text"))).withColumn("n_tokens", F.col("_chunk.n_tokens"))
    return S.with_identity(made.drop("_at", "_chunk"))


def links(chunks: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Edges of chunks: to their source, and to the previous and the next of the same source."""
    w = W.partitionBy("ref_doc_id").orderBy("ord")
    rows = chunks.where("ref_doc_id is not null").select("node_id", "ref_doc_id", "ord", F.lag("node_id").over(w).alias("_p"), F.lead("node_id").over(w).alias("_n"))
    if parents is not None:
        hashes = parents.select(F.col("node_id").alias("ref_doc_id"), F.col("node_hash").alias("_h")).dropDuplicates(["ref_doc_id"])
        rows = rows.join(hashes, "ref_doc_id", "left")
    else:
        rows = rows.withColumn("_h", F.lit(None).cast("string"))
    edge = lambda rel, dst, kind, h: F.struct(F.lit(rel).alias("rel"), dst.alias("dst_id"), F.lit(kind).alias("dst_type"), h.alias("dst_hash"))
    none = F.lit(None).cast("string")
    edges = F.array(edge("SOURCE", F.col("ref_doc_id"), "Document", F.col("_h")), edge("PREVIOUS", F.col("_p"), "Text", none), edge("NEXT", F.col("_n"), "Text", none))
    return rows.select(F.col("node_id").alias("src_id"), "ord", F.explode(F.filter(edges, lambda e: e["dst_id"].isNotNull())).alias("e")).select("src_id", "e.rel", "ord", "e.dst_id", "e.dst_type", "e.dst_hash")


def chunk_numbers(sizes: Column, limit: int) -> Column:
    """For an array of sizes in order, the chunk that each goes to when filled greedily without overlap (an array of ints).

    In Arrow batches: a fold of the JVM would copy the array for each element.
    """

    def number(batch: pd.Series) -> pd.Series:
        out = []
        for row in batch:
            total, chunk, own = 0, 0, []
            for n in () if row is None else row.tolist():
                if total > 0 and total + n > limit:
                    total, chunk = 0, chunk + 1
                total += n
                own.append(chunk)
            out.append(None if row is None else own)
        return pd.Series(out)

    return F.pandas_udf(number, T.ArrayType(T.IntegerType()))(sizes)


# ---- by meaning ----


def semantic_distances(sentences: DataFrame, doc: str = "doc_id", pos: str = "pos", vec: str = "embedding", buffer: int = 1) -> DataFrame:
    """(doc, pos, dist): one minus the cosine of the mean of up to ``buffer`` vectors that end at a sentence and of as many that follow it."""
    if buffer < 1:
        raise ValueError("buffer must be 1 or more")
    w = W.partitionBy(doc).orderBy(pos)
    if buffer == 1:
        pairs = sentences.select(doc, pos, F.col(vec).alias("_a"), F.lead(vec).over(w).alias("_b"))
    else:
        back, ahead = F.collect_list(vec).over(w.rowsBetween(1 - buffer, 0)), F.collect_list(vec).over(w.rowsBetween(1, buffer))
        pairs = sentences.select(doc, pos, back.alias("_x"), ahead.alias("_y")).select(doc, pos, V.mean(F.col("_x")).alias("_a"), F.when(F.size("_y") > 0, V.mean(F.col("_y"))).alias("_b"))
    return pairs.where("_b is not null").select(doc, pos, (1.0 - V.cosine(F.col("_a"), F.col("_b"))).alias("dist"))


def percentile_by_rank(values: Column, percent: float, default: float = 0.5) -> Column:
    """The value at rank floor(n * percent / 100), the last at most, of an array; ``default`` if it is empty."""
    n = F.size(values)
    at = F.least(F.floor(n * F.lit(percent) / 100.0).cast("int"), n - 1)
    return F.when(n > 0, F.get(F.array_sort(values), at)).otherwise(F.lit(default))


def semantic_chunk_ids(sentences: DataFrame, distances: DataFrame, doc: str = "doc_id", pos: str = "pos", percent: float = 95.0, most: int = 1000) -> DataFrame:
    """(doc, pos, chunk): a chunk ends after a sentence whose distance exceeds the document's threshold, or after ``most`` sentences."""
    thr = distances.groupBy(doc).agg(percentile_by_rank(F.collect_list("dist"), percent).alias("_thr"))
    rows = sentences.select(doc, pos).join(distances, [doc, pos], "left").join(thr, doc, "left")
    w = W.partitionBy(doc).orderBy(pos)
    cut = F.coalesce((F.col("dist") > F.col("_thr")).cast("int"), F.lit(0))
    rows = rows.withColumn("_cut", cut).withColumn("_part", F.coalesce(F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = F.floor((F.row_number().over(W.partitionBy(doc, "_part").orderBy(pos)) - 1) / most)
    rows = rows.withColumn("_sub", inner)
    new = ((F.lag("_part").over(w) != F.col("_part")) | (F.lag("_sub").over(w) != F.col("_sub"))).cast("int")
    return rows.withColumn("chunk", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).select(doc, pos, "chunk")


def semantic_chunks(sentences: DataFrame, ids: DataFrame, doc: str = "doc_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """(doc, chunk, text): sentences of a chunk joined by spaces."""
    rows = sentences.join(ids, [doc, pos])
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    return rows.groupBy(doc, "chunk").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("text"))


def semantic_nodes(nodes: DataFrame, embed: Callable[[DataFrame], DataFrame], percent: float = 95.0, most: int = 1000, buffer: int = 1) -> DataFrame:
    """Nodes split where the meaning shifts, each with its source's metadata and exclude-lists, ``ref_doc_id`` and ``ord``.

    ``embed`` adds ``embedding`` to rows with ``text``.  Nodes that aren't text,
    or have no sentence, pass as they are; nodes that are equal are split once.
    """
    doc = F.sha2(F.concat_ws(":", "node_id", "node_hash").cast("binary"), 256)
    keyed = nodes.withColumn("_doc", doc)
    distinct = keyed.where(F.col("kind") == S.TEXT).dropDuplicates(["_doc"]).select("_doc", F.posexplode(TX.sentences(F.col("text"))).alias("pos", "text"))
    rows = embed(distinct)
    pieces = semantic_chunks(rows, semantic_chunk_ids(rows, semantic_distances(rows, "_doc", buffer=buffer), "_doc", percent=percent, most=most), "_doc")
    made = keyed.join(pieces.select("_doc", "chunk", F.col("text").alias("_chunk")), "_doc", "left")
    whole = F.col("_chunk").isNull()
    made = made.withColumn("ref_doc_id", F.when(whole, F.col("ref_doc_id")).otherwise(F.col("node_id"))).withColumn("ord", F.when(whole, F.col("ord")).otherwise(F.col("chunk")))
    return S.with_identity(made.withColumn("text", F.coalesce("_chunk", "text")).drop("_doc", "_chunk", "chunk"))
