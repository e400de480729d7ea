"""A tree of summaries: built level by level, kept as nodes and edges, and descended by a selector."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone import schema as S

if TYPE_CHECKING:
    from quernstone.sources.store import StorageContext

FANOUT = 5


def group_key(file_path: Column, url: Column | None = None) -> Column:
    return F.coalesce(file_path, url if url is not None else F.lit(None).cast("string"), F.lit("default_group"))


def positions(nodes: DataFrame, key: str, order: str, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``nodes`` with ``position``: from 0 in order within each key, however many rows a key has.

    Rows are dealt by ranges of key and order, so a large key is spread over many
    tasks; a row's place within its task's range is known from the sort, and the
    places where keys' ranges begin from one row for each key and task.
    """
    ranged = nodes.repartitionByRange(key, order).sortWithinPartitions(key, order)
    at = F.monotonically_increasing_id()
    ranged = store(ranged.withColumn("_task", F.shiftright(at, 33).cast("int")).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    parts = ranged.groupBy(key, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col(key).alias("_key"), F.col("_task").alias("_of"), (before - F.col("_first")).alias("_shift"))
    joined = ranged.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_task") == F.col("_of")))
    return joined.select(*nodes.columns, (F.col("_at") + F.col("_shift")).alias("position"))


def level_groups(nodes: DataFrame, key: str, order: str, store: Callable[[DataFrame, str], DataFrame], fanout: int = FANOUT) -> DataFrame:
    """``nodes`` with ``bucket``: runs of ``fanout`` in order within each key."""
    return positions(nodes, key, order, store).withColumn("bucket", F.floor(F.col("position") / fanout).cast("long")).drop("position")


def _prompt(rows: Column) -> Column:
    """Texts numbered from 0; rows without text keep their number."""
    lines = F.transform(rows, lambda x, i: F.when(x["t"].isNotNull(), F.concat(F.lit("Node "), i.cast("string"), F.lit(":\n"), x["t"], F.lit("\n\n"))))
    return F.array_join(F.filter(lines, lambda s: s.isNotNull()), "")


def level_prompts(grouped: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, bucket, prompt, children, first): the children's texts in their order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return grouped.groupBy(key, "bucket").agg(rows.alias("rows")).select(key, "bucket", _prompt(F.col("rows")).alias("prompt"), F.transform("rows", lambda x: x["o"]).alias("children"), F.get(F.col("rows"), F.lit(0))["o"].alias("first"))


def build(leaves: DataFrame, summarise: Callable[[Column], Column], store: Callable[[DataFrame, str], DataFrame], key: str = "key", fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the whole tree over ``leaves`` (node_id, key, ord, text).

    Levels are built until each key has one node; keys never meet, so there can
    be several roots.  A summary's id depends on its children and not on its
    words alone, so equal summaries stay apart and none is its own parent.
    ``store`` writes a level and reads it again, which cuts the lineage.  Only
    leaves are numbered: above them a node's place is its bucket, so a level is
    one aggregation of groups of ``fanout`` rows.
    """
    level = store(positions(leaves.select("node_id", key, "ord", "text"), key, "ord", store).withColumn("level", F.lit(0)), "level-0")
    nodes, edges, depth = level.drop("position"), None, 0
    while not level.where(F.col("position") > 0).isEmpty():
        depth += 1
        rows = F.array_sort(F.collect_list(F.struct(F.col("position").alias("p"), F.col("ord").alias("o"), F.col("node_id").alias("id"), F.col("text").alias("t"))))
        grouped = level.groupBy(key, F.floor(F.col("position") / fanout).cast("long").alias("position")).agg(rows.alias("rows"))
        name = F.sha2(F.array_join(F.array_sort(F.transform("rows", lambda x: x["id"])), ",").cast("binary"), 256)
        children = F.transform("rows", lambda x: F.struct(x["id"].alias("id"), x["o"].alias("o")))
        upper = store(grouped.select(name.alias("node_id"), key, F.col("position").cast("int").alias("ord"), summarise(_prompt(F.col("rows"))).alias("text"), "position", F.lit(depth).alias("level"), children.alias("children")), f"level-{depth}")
        found = upper.select(F.col("node_id").alias("src_id"), F.lit("CHILD").alias("rel"), F.explode("children").alias("c")).select("src_id", "rel", F.col("c.o").alias("ord"), F.col("c.id").alias("dst_id"))
        edges = found if edges is None else edges.unionByName(found)
        level = upper.drop("children")
        nodes = nodes.unionByName(level.drop("position"))
    if edges is None:
        edges = level.limit(0).select(F.col("node_id").alias("src_id"), F.lit("CHILD").alias("rel"), "ord", F.col("node_id").alias("dst_id"))
    return nodes, edges


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst_id").alias("node_id")), "node_id", "left_anti")


def descend(start: DataFrame, edges: DataFrame, select: Callable[[DataFrame], DataFrame], depth: int, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(query_id, node_id) after up to ``depth`` levels from ``start``.

    At each level the frontier's children, as (query_id, parent_id, node_id,
    ord), pass ``select``; nodes without children are carried along, branches of
    which nothing is selected end.  ``store`` writes each level's frontier and
    reads it again: a level reads the last one twice, so plans would double.
    """
    down = edges.where("rel = 'CHILD'").select(F.col("src_id").alias("parent_id"), F.col("dst_id").alias("child_id"), "ord")
    frontier = store(start.select("query_id", "node_id"), "frontier-0")
    for level in range(1, depth + 1):
        children = frontier.withColumnRenamed("node_id", "parent_id").join(down, "parent_id").select("query_id", "parent_id", F.col("child_id").alias("node_id"), "ord")
        if children.isEmpty():
            break
        leaves = frontier.join(down.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti").select("query_id", "node_id")
        frontier = store(leaves.unionByName(select(children).select("query_id", "node_id")), f"frontier-{level}")
    return frontier


def index_id(root_ids: list[str]) -> str:
    """A tree's name: the same for the same roots, in any order."""
    return "hidx_" + hashlib.sha256(",".join(sorted(root_ids)).encode()).hexdigest()[:12]


def save(nodes: DataFrame, edges: DataFrame, context: StorageContext) -> str:
    """Keeps a tree's summaries, its edges in both directions and its descriptor; returns the index id.

    The descriptor lists the roots, one for each key of the leaves.
    """
    found = sorted(r["node_id"] for r in roots(nodes, edges).select("node_id").collect())
    name = index_id(found)
    none = F.lit(None)
    made = nodes.where("level > 0").select(
        "node_id", F.col("node_id").alias("node_hash"), F.lit(S.TEXT).alias("kind"), "text", none.cast("binary").alias("bytes"), none.cast("array<int>").alias("tokens"), S.metadata().alias("metadata"),
        F.array().cast("array<string>").alias("excl_embed"), F.array().cast("array<string>").alias("excl_llm"), none.cast("string").alias("ref_doc_id"), F.col("ord").cast("int").alias("ord"),
    )
    context.docs.add(made)
    text = F.lit("Text").alias("dst_type")
    down = edges.select("src_id", "rel", F.col("ord").cast("int").alias("ord"), "dst_id", text, none.cast("string").alias("dst_hash"))
    up = edges.select(F.col("dst_id").alias("src_id"), F.lit("PARENT").alias("rel"), F.col("ord").cast("int").alias("ord"), F.col("src_id").alias("dst_id"), text, none.cast("string").alias("dst_hash"))
    context.edges.upsert(down.unionByName(up).dropDuplicates(["src_id", "rel", "dst_id"]))
    spark = nodes.sparkSession
    index = spark.range(1).select(F.lit(name).alias("index_id"), none.cast("string").alias("summary"), F.create_map(F.lit("root_node_ids"), F.lit(json.dumps(found))).alias("extra"))
    context.indexes.put(index, nodes.select(F.lit(name).alias("index_id"), "node_id", none.cast("string").alias("doc_id")))
    return name


def restore(context: StorageContext, name: str) -> tuple[DataFrame, DataFrame]:
    """(roots, edges) of a kept tree, ready for :func:`descend`; an unknown id is a KeyError."""
    found = json.loads(context.indexes.get(name)["extra"]["root_node_ids"])
    members = context.indexes.members.read().where(F.col("index_id") == name).select("node_id")
    edges = context.edges.read().where("rel = 'CHILD'").join(members.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi")
    spark = members.sparkSession
    return spark.createDataFrame([(r,) for r in found], "node_id string"), edges


def first_child(children: DataFrame) -> DataFrame:
    """A selector that takes each parent's first child."""
    return children.groupBy("query_id", "parent_id").agg(F.min_by("node_id", "ord").alias("node_id"))


def every_child(children: DataFrame) -> DataFrame:
    return children


# ---- selectors ----


def parse_choices(reply: Column, n: Column) -> Column:
    """Numbers of a comma-separated reply that are in range, in their order and with repeats."""
    numbers = F.transform(F.split(reply, ","), lambda s: F.when(F.trim(s).rlike("^[0-9]{1,9}$"), F.trim(s)).cast("int"))
    return F.filter(numbers, lambda i: i.isNotNull() & (i >= 0) & (i < n))


def choice_prompt(query: Column, parent: Column, choices: Column) -> Column:
    lines = F.transform(choices, lambda c, i: F.concat(F.lit("Choice "), i.cast("string"), F.lit(": "), c))
    return F.concat(F.lit("Question: "), query, F.lit("\nSummary of the branch: "), parent, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nAnswer with the numbers of the useful choices, separated by commas."))


def flatten_triplets(triplets: DataFrame) -> DataFrame:
    """(query, choice_pos, choice, parent_context, target): a row for each choice, target 1 where it was selected."""
    rows = triplets.select("query", "parent_context", "selected_indices", F.posexplode("choices").alias("choice_pos", "choice"))
    return rows.select("query", "choice_pos", "choice", "parent_context", F.array_contains("selected_indices", F.col("choice_pos")).cast("int").alias("target"))


class Perceptron:
    """Three layers over the query's, child's and parent's vectors: 3 x dim, 512, 128, 1, with a sigmoid at the end."""

    def __init__(self, dim: int, seed: int = 0, hidden: tuple[int, int] = (512, 128)):
        rng = np.random.default_rng(seed)
        sizes = [3 * dim, *hidden, 1]
        self.layers = [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]

    def forward(self, x: np.ndarray) -> np.ndarray:
        for w, b in self.layers[:-1]:
            x = np.maximum(x @ w + b, 0.0)
        w, b = self.layers[-1]
        return 1.0 / (1.0 + np.exp(-np.clip((x @ w + b)[:, 0], -60, 60)))

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 1e-3, decay: float = 1e-2) -> list[float]:
        """Full-batch AdamW on the cross-entropy; the losses."""
        state = [[np.zeros_like(p) for p in layer] + [np.zeros_like(p) for p in layer] for layer in self.layers]
        losses = []
        for t in range(1, steps + 1):
            acts = [x]
            for w, b in self.layers[:-1]:
                acts.append(np.maximum(acts[-1] @ w + b, 0.0))
            p = self.forward(x)
            losses.append(float(-(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)).mean()))
            grad = ((p - y) / len(y))[:, None]
            for i in reversed(range(len(self.layers))):
                w, b = self.layers[i]
                gw, gb = acts[i].T @ grad, grad.sum(axis=0)
                grad = (grad @ w.T) * (acts[i] > 0) if i else grad
                new = []
                for j, (param, g) in enumerate(((w, gw), (b, gb))):
                    state[i][j] = 0.9 * state[i][j] + 0.1 * g
                    state[i][j + 2] = 0.999 * state[i][j + 2] + 0.001 * g * g
                    step = (state[i][j] / (1 - 0.9**t)) / (np.sqrt(state[i][j + 2] / (1 - 0.999**t)) + 1e-8)
                    new.append(param - rate * (step + decay * param))
                self.layers[i] = tuple(new)
        return losses


def select_by_model(pairs: DataFrame, model: Perceptron, threshold: float = 0.5) -> DataFrame:
    """(query_id, parent_id, node_id, ord) with vectors q, c and p to the rows whose score reaches ``threshold``, with ``score``."""
    sent = pairs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in pairs.columns if c not in ("q", "c", "p")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.concatenate([np.array(b.column(c).to_pylist(), np.float64).reshape(b.num_rows, -1) for c in ("q", "c", "p")], axis=1)
            s = sent.value.forward(x) if b.num_rows else np.zeros(0)
            out = pa.record_batch([*[b.column(c) for c in keep], pa.array(s)], names=[*keep, "score"])
            yield out.filter(pa.array(s >= threshold))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keep).schema.fields)
    return pairs.mapInArrow(run, schema + ", score double")
