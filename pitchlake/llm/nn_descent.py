"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, and greedy search on it.

Equal vectors are one node, so a vector that a third of all rows share is one row here. The graph starts from blocks of
nodes that are neighbours along random directions. Then each round joins every node with its neighbours, both ways, and
compares these with one another: a neighbour's neighbour is likely a neighbour. Only pairs with a new edge are compared,
and only edges that beat a node's worst are passed on. Rounds end when few edges change.

A search holds the ``POOL`` nearest nodes found for each query, starts at the query's own node, and in every round expands
all that are not yet expanded; it ends when none is left. Distances are Euclidean, in double precision, on the given vectors.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without an id;
where vectors differ in length, those of the most common length (the longest of equals) take part; repeated rows count
once; with fewer candidates than asked for, all are returned; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm.storage import durable

#: Neighbours a node keeps, and reverse neighbours that a round looks at (a sample by hash: the method's own).
K = 24
BLOCK = 64
DIRECTIONS = 4
POOL = 128
MAX_ROUNDS = 10
#: A round that changes fewer than this share of all edges is the last.
SETTLED = 0.01


#: Query vectors that may be broadcast; more are joined by shuffle.
BROADCAST_QUERIES = 50_000


def _numbers(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    return np.stack([np.frombuffer(x, kind) for x in column.to_pylist()]).astype(np.float64)


def nodes_of(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, node) of every row that takes part, and (node, vec, exact) of the distinct vectors: single and double
    precision, packed."""
    vec = df[vec_col].cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(df[id_col].alias("vec_id"), vec.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.filter(fine & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.filter(F.size("v") == (lengths["n"] if lengths else 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy().reshape(len(lists), -1) + 0.0  # -0.0 becomes 0.0
            short, exact = (pa.array([row.tobytes() for row in flat.astype(kind)], pa.binary()) for kind in (np.float32, np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), short, exact], ["vec_id", "vec", "exact"])

    id_type = df.schema[id_col].dataType.simpleString()
    packed = durable(rows.mapInArrow(pack, f"vec_id {id_type}, vec binary, exact binary").distinct())
    nodes = durable(packed.groupBy("exact").agg(F.min("vec_id").alias("node"), F.first("vec").alias("vec")))
    members = packed.join(nodes.hint("merge"), "exact").select("vec_id", "node")
    return durable(members), nodes.select("node", "vec", "exact")


def _nearest(ids: np.ndarray, vecs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's ``k`` nearest other rows, flattened: (row, other, distance)."""
    squares = (vecs**2).sum(1)
    d = np.maximum(squares[:, None] + squares[None, :] - 2 * vecs @ vecs.T, 0)
    np.fill_diagonal(d, np.inf)
    k = min(k, len(ids) - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), int)
    return np.repeat(ids, k), ids[near].reshape(-1), np.take_along_axis(d, near, 1).reshape(-1)


_EDGE = "u {0}, v {0}, d double, fresh boolean"


def _edges(u, v, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(u), pa.array(v), pa.array(d, pa.float64()), pa.array(np.ones(len(u), bool))], ["u", "v", "d", "fresh"]
    )


def _first_edges(nodes: DataFrame, id_type: str, n: int, dim: int) -> DataFrame:
    """Edges inside blocks of nodes that follow one another along random directions."""
    directions = np.random.default_rng(7).standard_normal((DIRECTIONS, dim))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            along = _numbers(batch.column(1)) @ directions.T
            for j in range(DIRECTIONS):
                place = [batch.column(0), batch.column(1), pa.array(np.full(len(along), j)), pa.array(along[:, j])]
                yield pa.RecordBatch.from_arrays(place, ["node", "vec", "direction", "along"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while len(held) >= 3 * BLOCK:  # what is left for the end is a block or more
                yield from join(held.slice(0, BLOCK))
                held = held.slice(BLOCK)
        if held is not None and len(held):
            half = len(held) // 2 if len(held) >= 2 * BLOCK else len(held)
            yield from join(held.slice(0, half))
            if half < len(held):
                yield from join(held.slice(half))

    def join(table: pa.Table) -> Iterator[pa.RecordBatch]:
        direction = table.column(2).to_numpy()
        for j in np.unique(direction):
            part = table.filter(pa.array(direction == j)).combine_chunks()
            yield _edges(*_nearest(part.column(0).to_numpy(), _numbers(part.column(1).combine_chunks()), K))

    along = nodes.select("node", "vec").mapInArrow(project, f"node {id_type}, vec binary, direction long, along double")
    tasks = max(1, min(DIRECTIONS * n // 1024, 4096))
    dealt = along.repartitionByRange(tasks, "direction", "along").sortWithinPartitions("direction", "along")
    return dealt.mapInArrow(block, _EDGE.format(id_type))


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node; of repeated edges the one that is not fresh."""
    unique = edges.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    order = Window.partitionBy("u").orderBy("d", "v")
    return unique.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= k).drop("_nth")


def build_graph(nodes: DataFrame, k: int = K) -> DataFrame:
    """(u, v, d): up to ``k`` near nodes of every node, ``d`` the squared distance."""
    id_type = nodes.schema["node"].dataType.simpleString()
    n = nodes.count()
    first = nodes.first()
    graph = durable(_best(_first_edges(nodes, id_type, n, len(first["vec"]) // 4 if first else 0), k))
    for _ in range(MAX_ROUNDS):
        graph, changed = _round(nodes, graph, id_type, k)
        if changed <= SETTLED * n * k:
            break
    return graph.select("u", "v", "d")


def _round(nodes: DataFrame, graph: DataFrame, id_type: str, k: int) -> tuple[DataFrame, int]:
    """One round of neighbours of neighbours: the new graph and the number of edges that are new in it."""
    towards = graph.select(F.col("v").alias("x"), F.col("u").alias("a"), "fresh")
    # Few reverse neighbours of each node, dealt out first so that a node which is near to many is not one task's work.
    dealt = Window.partitionBy("x", F.pmod(F.xxhash64("a"), F.lit(64))).orderBy(F.desc("fresh"), F.xxhash64("a", "x"))
    some = towards.withColumn("_nth", F.row_number().over(dealt)).filter(F.col("_nth") <= 4).drop("_nth")
    chosen = Window.partitionBy("x").orderBy(F.desc("fresh"), F.xxhash64("a", "x"))
    some = some.withColumn("_nth", F.row_number().over(chosen)).filter(F.col("_nth") <= k).drop("_nth")
    around = graph.select(F.col("u").alias("x"), F.col("v").alias("a"), "fresh").union(some)
    around = around.groupBy("x", "a").agg(F.max("fresh").alias("fresh"))
    worst = graph.groupBy("u").agg(F.max("d").alias("worst"), F.count("*").alias("n"))
    limit = F.when(F.col("n") >= k, F.col("worst")).otherwise(float("inf"))
    known = nodes.join(worst.hint("merge"), nodes["node"] == worst["u"], "left").select(
        "node", "vec", F.coalesce(limit, F.lit(float("inf"))).alias("worst")
    )
    met = around.join(known.hint("merge"), around["a"] == known["node"]).groupBy("x").agg(
        F.collect_list(F.struct("a", "fresh", "worst", "vec")).alias("near")  # at most 2 k of them
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            inner = lists.flatten()
            ids, fresh, worst = (inner.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            vecs = _numbers(inner.field(3)) if len(inner) else np.zeros((0, 1))
            ends = np.cumsum(lists.value_lengths().to_numpy())
            us, vs, ds, start = [], [], [], 0
            for end in ends:
                part, new, most, own = vecs[start:end], fresh[start:end], worst[start:end], ids[start:end]
                squares = (part**2).sum(1)
                d = np.maximum(squares[:, None] + squares[None, :] - 2 * part @ part.T, 0)
                i, j = np.nonzero((d < most[:, None]) & (new[:, None] | new[None, :]) & ~np.eye(len(own), dtype=bool))
                us.append(own[i])
                vs.append(own[j])
                ds.append(d[i, j])
                start = end
            if us:
                yield _edges(np.concatenate(us), np.concatenate(vs), np.concatenate(ds))

    found = met.select("near").mapInArrow(compare, _EDGE.format(id_type))
    # What was compared is no longer fresh.
    new = durable(_best(graph.withColumn("fresh", F.lit(False)).union(found), k))
    return new, new.filter("fresh").count()


def _distances(pairs: DataFrame, kind: type) -> DataFrame:
    """(query, node, d) of (query, node, q binary, vec binary)."""
    types = dict(pairs.dtypes)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = np.sqrt(((_numbers(batch.column(2), kind) - _numbers(batch.column(3), kind)) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], ["query", "node", "d"])

    chosen = pairs.select("query", "node", "q", "vec")
    return chosen.mapInArrow(measure, f"query {types['query']}, node {types['node']}, d double")


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, pool: int = POOL) -> DataFrame:
    """(query, node, d): the ``pool`` nearest nodes found for each query node (a column ``query`` of nodes)."""
    # Both ways: a node's own neighbours, and the nearest of those it is a neighbour of.
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "d")
    dealt = Window.partitionBy("u", F.pmod(F.xxhash64("v"), F.lit(64))).orderBy("d", "v")
    back = back.withColumn("_nth", F.row_number().over(dealt)).filter(F.col("_nth") <= K).drop("_nth")
    back = back.withColumn("_nth", F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))).filter(F.col("_nth") <= K)
    both = graph.select("u", "v").union(back.select("u", "v"))
    lists = durable(both.groupBy("u").agg(F.collect_set("v").alias("near")))  # at most 2 K each
    asked = durable(queries.join(nodes.hint("merge"), queries["query"] == nodes["node"]).select("query", "vec", "exact"))
    q = asked.select("query", F.col("vec").alias("q"))
    q = F.broadcast(q) if q.count() <= BROADCAST_QUERIES else q.hint("merge")
    vectors = nodes.select("node", "vec")
    # seen: everything measured so far, with the round in which it came.
    seen = durable(asked.select("query", F.col("query").alias("node"), F.lit(0.0).alias("d"), F.lit(True).alias("open")))
    order = Window.partitionBy("query").orderBy("d", "node")
    while True:
        ranked = seen.withColumn("_nth", F.row_number().over(order))
        frontier = ranked.filter((F.col("_nth") <= pool) & F.col("open")).select("query", F.col("node").alias("u"))
        reached = frontier.join(lists.hint("merge"), "u").select("query", F.explode("near").alias("node")).distinct()
        fresh = reached.join(seen.select("query", "node").hint("merge"), ["query", "node"], "left_anti")
        measured = _distances(fresh.join(vectors.hint("merge"), "node").join(q, "query"), np.float32)
        closed = ranked.withColumn("open", F.col("open") & (F.col("_nth") > pool)).drop("_nth")
        seen = durable(closed.union(measured.withColumn("open", F.lit(True))))
        top = seen.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= pool)
        if not top.filter("open").limit(1).count():
            break
    # What was found is measured again in double precision.
    pairs = top.select("query", "node").join(nodes.select("node", F.col("exact").alias("vec")).hint("merge"), "node")
    exact = asked.select("query", F.col("exact").alias("q"))
    return _distances(pairs.join(exact.hint("merge"), "query"), np.float64)


def nearest(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, pool: int = POOL
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row whose id is divisible by ``every``."""
    members, nodes = nodes_of(df, id_col, vec_col)
    graph = build_graph(nodes)
    asked = members.filter(F.col("vec_id") % every == 0)
    found = search(graph, nodes, asked.select(F.col("node").alias("query")).distinct(), pool)
    # A node stands for its rows, of which a query needs the k + 1 with the smallest ids at most.
    dealt = Window.partitionBy("node", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = members.withColumn("_nth", F.row_number().over(dealt)).filter(F.col("_nth") <= k + 1).drop("_nth")
    few = few.withColumn("_nth", F.row_number().over(Window.partitionBy("node").orderBy("vec_id")))
    few = durable(few.filter(F.col("_nth") <= k + 1).drop("_nth"))
    near = found.withColumn("_nth", F.row_number().over(Window.partitionBy("query").orderBy("d", "node")))
    near = durable(near.filter(F.col("_nth") <= k + 1).drop("_nth"))
    rows = near.join(few.hint("merge"), "node").select("query", "vec_id", "d")
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    pairs = own.join(rows.hint("merge"), "query").filter("vec_id <> query_id")
    place = Window.partitionBy("query_id").orderBy("d", "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("d").alias("score"))
