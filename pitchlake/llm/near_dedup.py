"""MinHash near-deduplication: improved consistent weighted samples of tf-idf shingles, banded, verified.

1. Equal word sequences are one *node* (16 bytes of hash); everything below is about nodes, so copies cost one row each.
2. Document frequencies: a fixed-size sketch finds the shingles that may be in more than ``FLOOR`` of all documents, and
   those are counted exactly. Rarer ones count as ``FLOOR``. A document made up mostly of frequent shingles counts once for
   its smallest frequent shingle: so a large group of near copies counts as a few documents and its own shingles are not
   marked down, while a passage that many different documents quote is.
3. ``BANDS`` x ``ROWS`` samples a node; nodes that agree in a band share a bucket.
4. In ``HUB_ROUNDS`` rounds one hub of each bucket is compared with the bucket's nodes of other components: weighted Jaccard
   similarity of the whole texts, at least ``SIMILAR``. The hub is the node that shares most buckets with others, so that a
   group of near copies is settled by about one comparison a node. Components then grow, and the hub leaves the bucket.
5. What is left, nodes of buckets that still span several components, is joined by prefixes: a node lists its rarest
   shingles, as many as a similar node could not do without, and only nodes that share one of these, and whose remaining
   weight allows the similarity, are compared, in rounds of hubs again. This loses no link between components.

Defined results: null text counts as empty; texts without words are in a class only with texts identical to them; texts of
one to four words are one shingle; repeated rows and null ids are rows like others; a class's id is its smallest document id
(null if all are null); an empty table gives an empty table; other columns may bear any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm import shingles as S
from pitchlake.llm.storage import durable, tidy

SIMILAR = 0.8
BANDS, ROWS = 10, 3
HUB_ROUNDS = 2
#: Nodes of one shingle that meet in one task, and comparisons with one hub that share a copy of its text.
BLOCK = 4096
#: Share of all documents from which a shingle's frequency counts. No more than (mean distinct shingles of a document) /
#: floor shingles can be above it; where that could pass ``MAX_HEAVY``, the floor is the mean / ``MAX_HEAVY``.
FLOOR = 0.01
MAX_HEAVY = 4_000_000
#: Classes that hold more than 1 / HUGE of all rows are joined apart.
HUGE = 200
#: Share of a document's shingles that must be frequent for it to count with its like.
MOSTLY = 0.5


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches of about ``PIECE`` bytes, with their texts."""
    for batch in batches:
        sizes = np.array([0 if t is None else len(t) for t in batch.column(column).to_pylist()], dtype=np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // S.PIECE)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(sizes)]):
            if b > a:
                part = batch.slice(a, b - a)
                yield part, [t or "" for t in part.column(column).to_pylist()]


def _sketch(docs: DataFrame) -> tuple[int, float, set[int]]:
    """Number of documents, the floor, and the sketch buckets whose load reaches it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads, n = np.zeros(S.BUCKETS, np.int64), 0
        for _, texts in _batches(batches, 0):
            n += len(texts)
            found = [S.shingles(h)[0] for h in S.words(texts)]
            loads += np.bincount(S.bucket_of(np.concatenate(found)), minlength=S.BUCKETS)
        at = np.flatnonzero(loads)
        # The number of documents rides along as bucket -1.
        yield pa.RecordBatch.from_pydict({"bucket": np.append(at, -1), "n": np.append(loads[at], n)})

    summed = durable(docs.select("text").mapInArrow(tidy(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    n_docs, found = summed.agg(F.sum(F.when(F.col("bucket") < 0, F.col("n"))), F.sum(F.when(F.col("bucket") >= 0, F.col("n")))).first()
    n_docs = n_docs or 0
    floor = max(FLOOR, (found or 0) / max(1, n_docs) / MAX_HEAVY)
    loaded = summed.filter((F.col("bucket") >= 0) & (F.col("n") > floor * n_docs)).select("bucket").toArrow()
    return n_docs, floor, set(loaded.column(0).to_pylist())  # at most BUCKETS


def document_frequencies(docs: DataFrame) -> S.Weights:
    """Weights from the document frequencies of all texts of ``docs`` (a column ``text``)."""
    n_docs, floor, loaded = _sketch(docs)
    table = np.zeros(S.BUCKETS, dtype=bool)
    table[sorted(loaded)] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            pairs = np.concatenate(kept)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            first = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))[: len(pairs)])
            n = np.diff(np.append(first, len(pairs)))
            one = pairs[first].view(np.int64)
            return pa.RecordBatch.from_pydict({"shingle": one[:, 0], "like": one[:, 1], "n": n.astype(np.int64)})

        kept, size = [], 0
        for _, texts in _batches(batches, 0):
            for hashes in S.words(texts):
                found = S.shingles(hashes)[0]
                heavy = found[table[S.bucket_of(found)]]
                if len(heavy):
                    like = heavy[0] if len(heavy) >= MOSTLY * len(found) else np.uint64(0)
                    kept.append(np.stack([heavy, np.full(len(heavy), like)], axis=1))
                    size += len(heavy)
            if size > 1 << 20:
                yield flushed()
                kept, size = [], 0
        if size:
            yield flushed()

    counts = docs.select("text").mapInArrow(tidy(count), "shingle long, like long, n long").groupBy("shingle", "like").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("shingle").agg(F.sum(F.when(F.col("like") == 0, F.col("n")).otherwise(1)).alias("n"))
    got = durable(counts.filter(F.col("n") > floor * n_docs)).toArrow()  # at most MAX_HEAVY
    return S.Weights(
        n_docs, floor, got.column(0).to_numpy().astype(np.int64).view(np.uint64), got.column(1).to_numpy().astype(np.float64)
    )


def text_key(text: str | Column) -> Column:
    """128 bits by which a text is found again."""
    return F.unhex(F.md5(text)).alias("text_key")


def _nodes(docs: DataFrame, weights) -> DataFrame:
    """(id, text_key, node, bands array<long>): no bands for a text without words."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = S.Sampler(BANDS * ROWS)
        for part, texts in _batches(batches, 1):
            hashes = S.words(texts)
            names = [S.identity(t, h) for t, h in zip(texts, hashes)]
            sets = [(s, weights.value.of(s, tf)) for s, tf in map(S.shingles, hashes)]
            samples = sampler(sets).reshape(len(sets), BANDS, ROWS)
            bands = np.zeros((len(sets), BANDS), np.uint64)
            for row in range(ROWS):
                bands = S.mix(bands * np.uint64(3) + samples[:, :, row])
            sizes = np.where([len(s) > 0 for s, _ in sets], BANDS, 0)
            values = pa.array(bands[sizes > 0].reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)
            columns = [part.column(0), part.column(2), pa.array(names, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_key", "node", "bands"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", text_key("text")).mapInArrow(tidy(apply), f"id {id_type}, text_key binary, node binary, bands array<long>")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text): a text of every wanted (node, text_key). Texts of one node have the same words: any will do."""
    found = docs.select("text", text_key("text")).join(wanted.hint("merge"), "text_key")
    return found.groupBy("node").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """The pairs (u, v) whose texts are similar. Many may name one ``v``: its text is dealt out in copies, one a ``BLOCK``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}

        def features(node: bytes, text: str) -> tuple:
            if node not in known:
                if len(known) >= 8:
                    known.clear()
                shingle, tf = S.shingles(S.words([text])[0])
                known[node] = (shingle, weights.value.of(shingle, tf))
            return known[node]

        for batch in batches:
            u, v, a, b = (batch.column(i).to_pylist() for i in range(4))
            keep = [S.similarity(features(*x), features(*y)) >= SIMILAR for x, y in zip(zip(u, a), zip(v, b))]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    copies = pairs.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("copies"))
    dealt = pairs.join(copies.hint("merge"), "v").withColumn("copy", F.pmod(F.xxhash64("u"), F.col("copies")).cast("int"))
    left = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    right = texts.select(F.col("node").alias("v"), F.col("text").alias("b")).join(copies.hint("merge"), "v")
    right = right.select("v", "b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    joined = dealt.join(left.hint("merge"), "u").join(right.hint("merge"), ["v", "copy"])
    return joined.select("u", "v", "a", "b").mapInArrow(tidy(apply), "u binary, v binary")


def _prefixes(nodes: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """(shingle, node, label, total, rest): the rarest shingles of each node that a similar node must share one of, with the
    node's weight and what of it is left from there on. Of two nodes with similarity ``SIMILAR``, each has that share of its
    weight in common with the other, so what comes before the first common shingle weighs no more than the rest of it."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _batches(batches, 2):
            for n, hashes in enumerate(S.words(found)):
                shingle, tf = S.shingles(hashes)
                own = [pa.array([part.column(i)[n].as_py()] * len(shingle), pa.binary()) for i in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(shingle.view(np.int64)), pa.array(weights.value.of(shingle, tf))], ["node", "label", "shingle", "w"]
                )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                found = batch.column(2)[n].values
                often, shingle, w = (found.field(i).to_numpy() for i in range(3))
                order = np.lexsort((shingle, often))
                often, shingle, w = often[order], shingle[order], w[order]
                total = float(w.sum())
                rest = np.cumsum(w[::-1])[::-1]
                at = np.flatnonzero((often > 1) & (rest >= SIMILAR * total * (1 - 1e-9)))
                own = [pa.array([batch.column(i)[n].as_py()] * len(at), pa.binary()) for i in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shingle[at]), *own, pa.array(np.full(len(at), total)), pa.array(rest[at])],
                    ["shingle", "node", "label", "total", "rest"],
                )

    spread_out = nodes.join(texts.hint("merge"), "node").select("node", "label", "text")
    features = durable(spread_out.mapInArrow(tidy(spread), "node binary, label binary, shingle long, w double"))
    often = features.groupBy("shingle").agg(F.count("*").alias("often"))
    counted = features.join(often.hint("merge"), "shingle")
    whole = counted.groupBy("node", "label").agg(F.collect_list(F.struct("often", "shingle", "w")).alias("found"))  # one text's
    return whole.mapInArrow(tidy(choose), "shingle long, node binary, label binary, total double, rest double")


def _linked_by_prefix(nodes: DataFrame, labels: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """``labels`` (node, label) after every link between similar nodes of different components, of all of ``nodes``.

    In rounds: the nodes of a shingle are taken in a fixed order, each as a hub of those behind it that are of another
    component and may be similar, until the shingle has asked for as many comparisons as it has nodes. Components then grow,
    and the next round goes on from there. So a round is linear, and what one link settles is not compared again.
    """
    listed = durable(_prefixes(nodes, texts, weights))
    sizes = listed.groupBy("shingle").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
    sizes = sizes.filter("a <> b").select("shingle", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = listed.drop("label").join(sizes.hint("merge"), "shingle")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A shingle's nodes are one block, but for very common ones: there each block meets every other once, and itself.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")
    dealt = durable(dealt.withColumn("begun", F.lit(0)))
    tested = None

    def meet(group: pa.Table) -> pa.Table:
        node, total, rest = np.array(group["node"].to_pylist(), dtype="S16"), *(group[c].to_numpy() for c in ("total", "rest"))
        order = np.lexsort((node, -rest / total))
        total, rest, own = total[order], rest[order], group["own"].to_numpy()[order]
        component = np.unique(np.array(group["label"].to_pylist(), dtype=object)[order], return_inverse=True)[1]
        shingle, i, j, hub = (group[c][0].as_py() for c in ("shingle", "i", "j", "begun"))
        n, asked, u, v = len(order), 0, [], []
        if component.max() == component.min():
            hub = n
        while hub < n and asked < n:
            need = SIMILAR / (1 + SIMILAR) * (total[hub] + total[hub + 1 :]) * (1 - 1e-9)
            fits = (np.minimum(rest[hub], rest[hub + 1 :]) >= need) & (component[hub + 1 :] != component[hub])
            met = hub + 1 + np.flatnonzero(fits & ((own[hub + 1 :] == own[hub]) == (i == j)))
            u += [int(x) for x in order[met]]
            v += [int(order[hub])] * len(met)
            asked += len(met)
            hub += 1
        names = group["node"].combine_chunks()
        pairs = [names.take(pa.array([*x, None], pa.int64())) for x in (u, v)]  # the last row says how far it came
        kind = pa.schema([("shingle", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("u", pa.binary()), ("v", pa.binary()), ("begun", pa.int32())])
        many = len(u) + 1
        return pa.table([[shingle] * many, [i] * many, [j] * many, *pairs, [hub if hub < n else None] * many], schema=kind)

    while True:
        named = dealt.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        kind = "shingle long, i int, j int, u binary, v binary, begun int"
        out = durable(named.groupBy("shingle", "i", "j").applyInArrow(meet, kind))
        pairs = out.filter("u IS NOT NULL").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        pairs = durable(pairs if tested is None else pairs.join(tested.hint("merge"), ["u", "v"], "left_anti"))
        tested = pairs if tested is None else durable(tested.union(pairs))
        labels = joined(labels, durable(_verified(pairs, texts, weights)))
        left = out.filter("u IS NULL AND begun IS NOT NULL").select("shingle", "i", "j", "begun")
        dealt = durable(dealt.drop("begun").join(left.hint("merge"), ["shingle", "i", "j"]))
        if dealt.isEmpty():
            return labels


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (u, v): the label is the smallest node of its component.

    Labels go to neighbours and along labels, so a path of length n needs about log n rounds.
    """
    both = durable(edges.union(edges.select("v", "u")).distinct())
    labels = durable(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        told = both.join(labels.hint("merge"), both["v"] == labels["node"]).select(F.col("u").alias("node"), "label")
        spread = labels.union(told).groupBy("node").agg(F.min("label").alias("label"))
        parent = spread.select(F.col("node").alias("label"), F.col("label").alias("above"))
        merged = spread.join(parent.hint("merge"), "label", "left").select("node", F.coalesce("above", "label").alias("label"))
        new = durable(merged)
        changed = new.join(labels.withColumnRenamed("label", "old").hint("merge"), "node").filter("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after new links: components meet as single nodes, so old links are not walked again."""
    of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label")).hint("merge")
    between = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(
        F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v")
    )
    moved = components(between.filter("u <> v").distinct())
    old = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")).hint("merge"), "label", "left")
    old = old.select("node", F.coalesce("to", "label").alias("label"))
    return durable(old.union(moved.join(labels.select("node").hint("merge"), "node", "left_anti")))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, node, class_id, class_size, stays), one narrow row per row of ``df``; ``stays`` marks the (id, text_key)
    that represents the class: its smallest id, null last."""
    sc = df.sparkSession.sparkContext
    docs = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    weights = sc.broadcast(document_frequencies(docs))
    rows = durable(_nodes(docs, weights))
    nodes = rows.filter(F.size("bands") > 0).groupBy("node").agg(F.first("bands").alias("bands"), F.min("text_key").alias("text_key"))
    entries = nodes.select("node", "text_key", F.posexplode("bands").alias("band", "value"))
    shared = entries.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1")
    entries = durable(entries.join(shared.hint("merge"), ["band", "value"]))
    # How many others a node meets, over all its buckets: who meets most is in the middle of its group.
    central = durable(entries.groupBy("node").agg(F.sum("n").alias("central"), F.first("text_key").alias("text_key")))
    texts = durable(_texts_of(docs, central.select("node", "text_key")))
    entries = entries.select("band", "value", "node", F.col("node").alias("label"), F.lit(True).alias("apart"))
    entries, labels = entries.join(central.select("node", "central").hint("merge"), "node"), None
    for _ in range(HUB_ROUNDS):
        entries = durable(entries)
        hubs = entries.groupBy("band", "value").agg(F.max(F.struct("apart", "central", "node", "label")).alias("hub"))
        hubs = durable(hubs.select("band", "value", F.col("hub.node").alias("hub"), F.col("hub.label").alias("hub_label")))
        met = entries.join(hubs.hint("merge"), ["band", "value"])
        pairs = met.filter(F.col("label") != F.col("hub_label")).select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
        found = durable(_verified(durable(pairs), texts, weights))
        labels = components(found) if labels is None else joined(labels, found)
        # The hub leaves its bucket, the next one is of another component; a bucket of one component is done.
        named = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"{name}_label")).hint("merge")
        rest = met.filter(F.col("node") != F.col("hub")).drop("label", "hub_label")
        rest = rest.join(named("node"), "node", "left").join(named("hub"), "hub", "left")
        rest = rest.withColumn("label", F.coalesce("node_label", "node"))
        rest = rest.withColumn("apart", F.col("label") != F.coalesce("hub_label", "hub"))
        rest = durable(rest.select("band", "value", "node", "label", "apart", "central"))
        mixed = rest.groupBy("band", "value").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b")
        entries = rest.join(mixed.select("band", "value").hint("merge"), ["band", "value"])
    left = durable(entries.select("node", "label").distinct())
    labels = _linked_by_prefix(left, labels, texts, weights)

    named = rows.select("id", "text_key", "node").join(labels.hint("merge"), "node", "left")
    named = durable(named.select("id", "text_key", "node", F.coalesce("label", "node").alias("label")))
    rank = F.struct(F.col("id").isNull(), "id", "text_key")
    totals = durable(named.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"), F.min(rank).alias("first")))
    out = ["id", "text_key", "node", "class_id", "class_size", (rank == F.col("first")).alias("stays")]
    # No more than HUGE classes can hold a share of 1 / HUGE of all rows: those are broadcast, the rest meet by label.
    huge = F.broadcast(totals.filter(F.col("class_size") > named.count() / HUGE))
    ordinary = named.join(huge.select("label"), "label", "left_anti").join(totals.hint("merge"), "label")
    return named.join(huge, "label").select(*out).unionByName(ordinary.select(*out))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each class, with its own columns."""
    kept = durable(classes(df, id_col, text_col).filter("stays").select("id", "text_key").distinct())
    text = F.coalesce(df[text_col], F.lit(""))
    own = df.select(F.struct(*df.columns).alias("row"), df[id_col].alias("_id"), text_key(text).alias("_key"))
    joined = own.join(kept.hint("merge"), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("text_key")))
    one = Window.partitionBy("_id", "_key").orderBy(F.lit(0))
    return joined.withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").select("row.*")
