"""Packing of retrieved texts into prompts, and answers refined over several of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.config import SynthesizerConfig
from quernstone.functions import text as TX

from . import models

ANSWER = "Context:\n{context}\n\nWith this context alone, answer the question: {query}\nAnswer: "
REFINE = "Question: {query}\nAnswer so far: {answer}\nMore context:\n{context}\n\nImprove the answer where the context helps, or repeat it. Answer: "
NOTHING = "No relevant context found to answer the query."


def pack(sizes: Column, texts: Column, first: Column | int, later: Column | int, limit: int) -> Column:
    """Chunks (an array of texts) of the rows of an ordered group.

    A chunk is closed where the next text would pass ``limit`` and it has one
    already; counts start from the template's own (``first``, then ``later``).
    Joints of two line ends aren't counted, and a text larger than the limit has
    a chunk of its own.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    zero = F.struct(lit(first).cast("long").alias("total"), F.array().cast("array<string>").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        full = (F.size(acc["held"]) > 0) & (acc["total"] + x["n"] > limit)
        total = F.when(full, lit(later).cast("long")).otherwise(acc["total"]) + x["n"]
        held = F.when(full, F.array(x["t"])).otherwise(F.concat(acc["held"], F.array(x["t"])))
        out = F.when(full, F.concat(acc["out"], F.array(F.array_join(acc["held"], "\n\n")))).otherwise(acc["out"])
        return F.struct(total.alias("total"), held.alias("held"), out.alias("out"))

    pairs = F.filter(F.zip_with(sizes.cast("array<bigint>"), texts, lambda n, t: F.struct(n.alias("n"), t.alias("t"))), lambda x: x["t"].isNotNull())
    return F.aggregate(pairs, zero, step, lambda acc: F.when(F.size(acc["held"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["held"], "\n\n")))).otherwise(acc["out"]))


def compact(rows: DataFrame, queries: DataFrame, config: SynthesizerConfig = SynthesizerConfig(), tokens: Callable[[Column], Column] = TX.token_count) -> DataFrame:
    """(query_id, query, chunks) of ranked rows (query_id, rank, text); a query without rows has no chunk."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text", tokens(F.col("text")).alias("n"))))
    grouped = rows.groupBy("query_id").agg(ordered.alias("_rows"))
    first = tokens(F.replace(F.replace(F.lit(ANSWER), F.lit("{context}"), F.lit("")), F.lit("{query}"), F.col("query")))
    later = tokens(F.replace(F.replace(F.replace(F.lit(REFINE), F.lit("{context}"), F.lit("")), F.lit("{answer}"), F.lit("")), F.lit("{query}"), F.col("query")))
    joined = queries.join(grouped, "query_id", "left")
    chunks = pack(F.transform("_rows", lambda x: x["n"]), F.transform("_rows", lambda x: x["text"]), first, later, config.limit)
    return joined.select("query_id", "query", F.coalesce(chunks, F.array().cast("array<string>")).alias("chunks"))


def answer(packed: DataFrame, model: models.LanguageModel) -> DataFrame:
    """(query_id, query, answer, n_calls): the first chunk answers, each later one refines; queries run side by side."""
    kind = packed.schema["query_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            replies = []
            for query, chunks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                reply = NOTHING
                for i, context in enumerate(chunks or []):
                    template = ANSWER if i == 0 else REFINE
                    reply = model.complete(template.replace("{query}", query or "").replace("{answer}", reply).replace("{context}", context))
                replies.append(reply)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(replies, pa.string()), pa.array([len(c or []) for c in b.column(2).to_pylist()], pa.int32())], names=["query_id", "query", "answer", "n_calls"])

    return packed.select("query_id", "query", "chunks").mapInArrow(run, f"query_id {kind}, query string, answer string, n_calls int")


def query_engine(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], postprocess: list[Callable[[DataFrame], DataFrame]], model: models.LanguageModel, config: SynthesizerConfig = SynthesizerConfig()) -> DataFrame:
    """Retrieve (to query_id, rank, text, score), post-process, pack and answer, for all queries at once."""
    rows = retrieve(queries)
    for step in postprocess:
        rows = rows.transform(step)
    return answer(compact(rows, queries.select("query_id", "query"), config), model)
