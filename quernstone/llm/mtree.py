"""Exact top-k inner products with an M-tree.

Vectors become points of a metric space in which the nearest are those of
highest inner product: with M the largest norm, x gains the coordinate
sqrt(M^2 - |x|^2) and a query gains 0, so d(q, x)^2 = |q|^2 + M^2 - 2 q.x.

The tree grows from the top.  A node of more than ``page_rows`` vectors promotes
up to ``fan`` routing objects, far apart in a bounded sample of its own vectors,
and each vector goes below the nearest; so on for each child, all nodes of a
level at once, until every node fits a page.  A node keeps its routing object,
its covering radius and the distance to its parent's routing object.  Where all
of a node's sample is one vector, its children would be the node again, and it
becomes several pages.  A page's entries keep their distance to the routing
object and stand in that order.  A page carries the chain of its ancestors, so no
task needs the whole tree; nothing of the tree is sent from the driver.

A search takes its queries in blocks of ``query_rows``: each is one broadcast and
one pass over the pages, whose candidates are written before the next begins.  A
task visits pages best first by their bound.  Three bounds avoid computations,
all by the triangle inequality on stored distances: a node is dropped by its
parent distance before its routing object is looked at, by its radius after that,
and blocks of a page's entries outside a query's ring are skipped.  Queries start
from the k-th best score over a sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common


def quantise(df: DataFrame, id_col: str, vec_col: str, factor: float = 1024.0) -> DataFrame:
    """(vec_id, vec): floor(factor * x) of each component as an array of longs; rows with a null id, a null vector or a null or non-finite component go."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad)
    return kept.select("vec_id", F.transform("x", lambda v: F.floor(v * factor).cast("long")).alias("vec"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of numbers as rows of ``dim``, shorter ones filled with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(lengths), dim))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def lift(x: np.ndarray, square: float) -> np.ndarray:
    """Data points with the coordinate that makes all norms equal."""
    return np.concatenate([x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0.0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """Indices of up to ``n`` points, each the farthest from those before."""
    if not len(points):
        return np.zeros(0, np.int64)
    chosen, far = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < min(n, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(points, points[chosen[-1:]])[:, 0])
    return np.array(chosen)


_CHAIN = "array<struct<node:string,parent:double,radius:double,routing:binary>>"
_PAGE = "cell string, n int, ids binary, entries binary, vecs binary"


def _pivots(rest: DataFrame, nodes: DataFrame, dim: int, square: float, fan: int, sample_rows: int) -> DataFrame:
    """(cell, parent_cell, parent, routing, flat): the children that each node of ``rest`` promotes, from a sample of its vectors."""
    share = F.lit(float(max(64, sample_rows))) / F.col("n") * (1 << 30)
    drawn = rest.join(nodes.select("cell", "n", F.get("chain", F.size("chain") - 1)["routing"].alias("routing")), "cell").where(F.pmod(F.xxhash64("vec_id", "row"), F.lit(1 << 30)) < share)

    def promote(table: pa.Table) -> pa.Table:
        cell, points = table.column("cell")[0].as_py(), lift(_matrix(table.column("vec"), dim), square)
        chosen = points[spread(points, fan)]
        above = table.column("routing")[0].as_py()
        far = [0.0] * len(chosen) if above is None else distances(chosen, np.frombuffer(above)[None])[:, 0].tolist()
        return pa.table({
            "cell": [f"{cell}.{i}" for i in range(len(chosen))], "parent_cell": [cell] * len(chosen), "parent": far,
            "routing": [x.tobytes() for x in chosen], "flat": [len(chosen) == 1] * len(chosen),
        })

    return drawn.select("cell", "routing", "vec").groupBy("cell").applyInArrow(promote, "cell string, parent_cell string, parent double, routing binary, flat boolean")


def _descend(rest: DataFrame, pivots: DataFrame, dim: int, square: float, parts: int) -> DataFrame:
    """Each row of ``rest`` below its nearest child, with its distance.

    A node's children come before its vectors in every part that holds some of
    them, so vectors stream past and a large node is shared by ``parts`` tasks.
    """
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    none = F.lit(None)
    first = pivots.select(F.col("parent_cell").alias("at"), part, F.lit(0).alias("kind"), "cell", "routing", none.cast("long").alias("vec_id"), none.cast("long").alias("row"), none.cast("array<long>").alias("vec"))
    then = rest.select(F.col("cell").alias("at"), F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), none.cast("string").alias("cell"), none.cast("binary").alias("routing"), "vec_id", "row", "vec")
    rows = first.unionByName(then).repartition("at", "part").sortWithinPartitions("at", "part", "kind")

    def below(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cells, routing = None, [], []
        for b in it:
            t = pa.Table.from_batches([b])
            names = list(zip(t.column("at").to_pylist(), t.column("part").to_pylist(), strict=True))
            new = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for s, e in zip(new, new[1:], strict=False):
                if names[s] != at:
                    at, cells, routing = names[s], [], []
                own = t.slice(s, e - s)
                children = int((own.column("kind").to_numpy() == 0).sum())
                if children:
                    cells += own.column("cell").slice(0, children).to_pylist()
                    routing += [np.frombuffer(x) for x in own.column("routing").slice(0, children).to_pylist()]
                for k in range(children, e - s, 4000):
                    part = own.slice(k, min(4000, e - s - k))
                    d = distances(lift(_matrix(part.column("vec"), dim), square), np.array(routing))
                    near = d.argmin(axis=1)
                    yield pa.record_batch([pa.array([cells[i] for i in near.tolist()], pa.string()), pa.array(d[np.arange(len(d)), near]), *(part.column(c).combine_chunks() for c in ("vec_id", "row", "vec"))], names=["cell", "d", "vec_id", "row", "vec"])

    return rows.mapInArrow(below, "cell string, d double, vec_id long, row long, vec array<long>")


def build(vectors: DataFrame, dim: int, square: float, fan: int = 64, page_rows: int = 1024, sample_rows: int = 2000, part_rows: int = 1 << 20, most_levels: int = 30) -> DataFrame:
    """The tree's pages with their chains of ancestors, stored.  ``vectors`` is a stored table of vec_id and vec."""
    spark = vectors.sparkSession
    rest = common.stored(vectors.select(F.lit("r").alias("cell"), "vec_id", F.monotonically_increasing_id().alias("row"), "vec"), "mtree-rows")
    left = rest.count()
    nodes = common.stored(spark.range(1).select(F.lit("r").alias("cell"), F.lit(left).cast("long").alias("n"), F.array().cast(_CHAIN).alias("chain")), "mtree-nodes")
    n_nodes, done, level = 1, [], 0
    while left:
        level += 1
        pivots = common.stored(_pivots(rest, nodes, dim, square, fan, sample_rows), "mtree-pivots")
        dealt = common.stored(_descend(rest, pivots, dim, square, max(1, -(-left // (n_nodes * part_rows)))), "mtree-dealt")
        size = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("radius"))
        one = F.struct(F.col("cell").alias("node"), "parent", "radius", "routing")
        below = pivots.join(size, "cell").join(nodes.select(F.col("cell").alias("parent_cell"), "chain"), "parent_cell")
        flat = F.col("flat") | F.lit(level >= most_levels)
        below = common.stored(below.select("cell", "n", (flat | (F.col("n") <= page_rows)).alias("leaf"), F.concat("chain", F.array(one)).cast(_CHAIN).alias("chain")), "mtree-nodes")
        leaves, inner = below.where("leaf").drop("leaf"), below.where("not leaf").drop("leaf")
        done.append((common.stored(_pages(dealt, leaves, dim, page_rows), "mtree"), below))
        nodes, left, n_nodes, last = inner, 0, inner.count(), rest
        if n_nodes:
            rest = common.stored(dealt.join(inner.select("cell"), "cell", "left_semi").select("cell", "vec_id", "row", "vec"), "mtree-rows")
            left = rest.count()
        common.drop(last, dealt, pivots)
    common.drop(rest)
    every = done[0][0]
    for pages, _ in done[1:]:
        every = every.unionByName(pages)
    common.drop(*[below for _, below in done])
    return every


def _pages(dealt: DataFrame, leaves: DataFrame, dim: int, page_rows: int) -> DataFrame:
    own = dealt.join(leaves.select("cell", "n"), "cell").withColumn("page", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / page_rows)).cast("int"))

    def page(table: pa.Table) -> pa.Table:
        e = table.column("d").to_numpy()
        order = np.argsort(e, kind="stable")
        cells = [table.column("cell")[0].as_py(), len(e), table.column("vec_id").to_numpy()[order].tobytes(), e[order].tobytes(), _matrix(table.column("vec"), dim)[order].astype(np.int64).tobytes()]
        kinds = [pa.string(), pa.int32(), *[pa.binary()] * 3]
        return pa.table([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=[x.split()[0] for x in _PAGE.split(", ")])

    made = own.select("cell", "page", "d", "vec_id", "vec").groupBy("cell", "page").applyInArrow(page, _PAGE)
    return made.join(leaves.select("cell", "chain"), "cell")


class Best:
    """The k highest scores of each query so far, ties to smaller ids."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.kth = floor.copy()
        self.q, self.score, self.vec = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        own = self.ids[q] != vec
        q, score, vec = np.append(self.q, q[own]), np.append(self.score, score[own]), np.append(self.vec, vec[own])
        order = np.lexsort((vec, -score, q))
        q, score, vec = q[order], score[order], vec[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = rank < self.k
        self.q, self.score, self.vec = q[keep], score[keep], vec[keep]
        last = rank[keep] == self.k - 1
        self.kth[self.q[last]] = np.maximum(self.kth[self.q[last]], self.score[last])


class Search:
    """The queries of a block, with what is known of the nodes they have met."""

    def __init__(self, queries: np.ndarray, square: float, best: Best, stats: dict | None = None, held_nodes: int = 512, block: int = 64):
        self.queries, self.best, self.stats, self.held_nodes, self.block = queries, best, stats, held_nodes, block
        self.lifted = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
        self.norms = (queries * queries).sum(axis=1) + square
        self.slack = 0.5 + 1e-9 * self.norms
        self.nodes: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def reach(self) -> np.ndarray:
        """No point farther than this can enter a query's best."""
        return np.sqrt(np.maximum(self.norms - 2.0 * (self.best.kth - self.slack), 0.0)) + 1e-6

    def count(self, what: str, n: int) -> None:
        if self.stats is not None:
            self.stats[what] = self.stats.get(what, 0) + n

    def node(self, link: dict, above: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """(least, distance) to a node for each query: a bound on its points' distances, and the distance to its routing object where that was computed, else infinity."""
        if (known := self.nodes.pop(link["node"], None)) is None:
            n = len(self.queries)
            # by the parent distance alone; a query that dropped the parent drops the child
            least = np.zeros(n) if above is None else np.where(np.isinf(above[1]), np.inf, np.maximum(above[0], np.abs(above[1] - link["parent"]) - link["radius"]))
            go, far = np.flatnonzero(least <= self.reach()), np.full(n, np.inf)
            self.count("avoided", n - len(go))
            self.count("routed", len(go))
            far[go] = distances(self.lifted[go], link["routing"][None])[:, 0]
            known = np.where(np.isinf(far), np.inf, np.maximum(least, far - link["radius"])), far
            if len(self.nodes) >= self.held_nodes:
                self.nodes.pop(next(iter(self.nodes)))  # the least lately met
        self.nodes[link["node"]] = known
        return known

    def visit(self, pages: list[dict]) -> None:
        """Searches some pages for all queries, best first.  Bounds are of the reach at the time, which only shrinks."""
        if not pages or not len(self.queries):
            return
        met = []
        for page in pages:
            at = None
            for link in page["chain"]:
                at = self.node(link, at)
            met.append(at)
        least = np.stack([x[0] for x in met], axis=1)
        order = np.argsort(least, axis=1, kind="stable")
        every = np.arange(len(self.queries))
        for step in range(len(pages)):
            j, far = order[:, step], self.reach()
            go = np.flatnonzero(least[every, j] <= far)
            if not len(go):
                break  # the bounds rise from step to step and the reach falls
            for p in np.unique(j[go]).tolist():
                self.search(pages[p], go[j[go] == p], met[p][1], far)

    def search(self, page: dict, q: np.ndarray, to_page: np.ndarray, far: np.ndarray) -> None:
        entries = page["entries"]
        low = np.searchsorted(entries, to_page[q] - far[q] - 1e-6, "left")
        high = np.searchsorted(entries, to_page[q] + far[q] + 1e-6, "right")
        for s in range(0, len(entries), self.block):
            e = min(s + self.block, len(entries))
            own = q[(low < e) & (high > s)]  # the queries whose ring has entries here
            if not len(own):
                continue
            self.count("computed", len(own) * (e - s))
            vecs = page["vecs"][s:e]
            score = self.queries[own] @ vecs.T if page["exact"] else self.queries[own].astype(np.int64) @ vecs.T
            a, b = np.nonzero(score >= self.best.kth[own][:, None])
            if len(a):
                self.best.add(own[a], score[a, b], page["ids"][s:e][b])


def opened(row: dict, dim: int) -> dict:
    """A stored page with its arrays."""
    vecs = np.frombuffer(row["vecs"], np.int64).reshape(-1, dim)
    exact = not vecs.size or float(np.abs(vecs).max()) ** 2 * dim < 2.0**52
    chain = [link | {"routing": np.frombuffer(link["routing"])} for link in row["chain"]]
    return row | {"chain": chain, "ids": np.frombuffer(row["ids"], np.int64), "entries": np.frombuffer(row["entries"]), "vecs": vecs.astype(np.float64) if exact else vecs, "exact": exact}


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", factor: float = 1024.0, fan: int = 64, page_rows: int = 1024, query_rows: int = 4096, sample_rows: int = 2000, held_pages: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``is_query`` picks by id, the ``k`` best of all other rows.

    Ties go to the smaller id, and fewer rows than ``k`` are all returned.  Rows
    with a null id or vector, or a null or non-finite component, take no part.
    Vectors of unequal length count as filled up with zeros.  Rows that repeat a
    query's id are no candidates of it; a query id that repeats is one query, by
    its least vector.  An empty table gives no row.
    """
    spark = vectors.sparkSession
    data = common.stored(quantise(vectors, id_col, vec_col, factor), "quantised")
    square_of = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    dim, square, n = data.agg(F.max(F.size("vec")), F.max(square_of), F.count("*")).first()
    empty = spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (("query_id", "long"), ("rank", "int"), ("vec_id", "long"), ("score", "long"))])
    if not n or not dim:
        return empty
    top_hash = 1 << 30
    picked = data.where(F.pmod(F.xxhash64("vec_id"), F.lit(top_hash)) < int(top_hash * min(1.0, sample_rows / n))).limit(2 * sample_rows).collect()
    fill = lambda rows: np.array([list(r["vec"]) + [0] * (dim - len(r["vec"])) for r in rows], np.float64).reshape(-1, dim)
    sample, sample_ids = fill(picked), np.array([r["vec_id"] for r in picked], np.int64)
    if not len(sample):
        sample, sample_ids = np.zeros((1, dim)), np.array([-1])
        known = 0
    else:
        known = len(sample)
    pages = build(data, dim, square, fan, page_rows, sample_rows)
    asked = data.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    blocks = max(1, -(-asked.count() // query_rows))
    found = []
    for block in range(blocks):
        rows = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)).orderBy("vec_id").collect()
        if not rows:
            continue
        queries, ids = fill(rows), np.array([r["vec_id"] for r in rows], np.int64)
        floor = np.full(len(rows), -np.inf)
        distinct = len(np.unique(sample_ids)) == known
        if known > k and distinct:
            scores = queries @ sample.T
            scores[ids[:, None] == sample_ids[None, :]] = -np.inf
            floor = np.partition(scores, known - k, axis=1)[:, known - k]
        sent = spark.sparkContext.broadcast((queries, ids, floor))

        def search(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries, ids, floor = sent.value
            best, held = Best(ids, floor, k), []
            running = Search(queries, square, best)
            for b in it:
                for row in b.to_pylist():
                    held.append(opened(row, dim))
                    if len(held) >= held_pages:
                        running.visit(held)
                        held = []
            running.visit(held)
            yield pa.record_batch([pa.array(ids[best.q]), pa.array(best.vec), pa.array(best.score.astype(np.int64))], names=["query_id", "vec_id", "score"])

        found.append(common.stored(pages.mapInArrow(search, "query_id long, vec_id long, score long"), "mtree-found"))
        sent.destroy()
    if not found:
        return empty
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
