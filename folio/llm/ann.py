"""The most similar vectors of every vector, by NN-descent, and greedy search in the graph it makes.

Vectors of unit length are the nodes; equal ones are one node, so copies cost nothing. The graph starts from blocks that overlap a little: each
node goes to the two blocks of its nearest centroids (fitted on a bounded sample) and is compared with all of a block in matrix products; a
block that would grow with the data is halved at medians until it doesn't. That start knows most of the neighbours only; the
rest comes from rounds of joins, in which the neighbours of each node, and those whose neighbour it is, are introduced to one another: a pair
is proposed if it beats the worst neighbour that either has, and only pairs with at least one neighbour that is new since the last round are
compared, until hardly any edge is new. New vectors are searched for by walking the graph from seeds of their nearest blocks, always on from
the best nodes found so far.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.session import replaced, tidied, written

#: Neighbours kept while the graph is made, those of them that are ranked exactly, blocks of each node, and the share of new edges at which the rounds end.
KEPT, RANKED, BLOCKS_EACH, ENOUGH = 14, 12, 2, 0.025
#: A node with more neighbours, forward and reverse, introduces them in parts of about so many, each part to each.
PART = 64
#: The centroids are fitted on so many nodes at most, of the largest models; a block has about, and at most, so many nodes.
SAMPLE, BLOCK, LARGEST = 16_384, 400, 4_096


def _no_constant(name: str) -> float:
    raise ValueError(name)


def parse_vector(text: str | list | None) -> tuple[int, bytes | None]:
    """(length, the unit vector as float32) of a JSON list or a list; length -1 for what isn't a complete one of numbers, no vector if all are zero."""
    try:
        found = json.loads(text, parse_constant=_no_constant) if text and isinstance(text, str) else text
        if not isinstance(found, list) or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in found):
            return -1, None
        v = np.array(found, np.float64)
    except (ValueError, RecursionError, OverflowError):
        return -1, None
    size = float(np.abs(v).max()) if len(v) else 0.0
    if not size or not np.isfinite(size):
        return len(v), None
    v /= size
    return len(v), (v / np.sqrt(v @ v)).astype(np.float32).tobytes()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [parse_vector(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["id", "model", "n", "vec"])


def usable(passages: DataFrame, key: str, model: str, embedding: str) -> DataFrame:
    """(id, model, vec): the usable vectors, at unit length: complete JSON lists, or arrays, not all zero, as long as most of their model are; repeated rows stay. Written to the shared folder."""
    kept = passages.select(F.col(key).alias("id"), F.col(model).alias("model"), F.col(embedding).alias("e")).where("id is not null and model is not null and e is not null")
    parsed = written(kept.mapInArrow(_parse, "id string, model string, n int, vec binary"), "vectors")
    different = parsed.where("n > 0").select("model", "n", F.xxhash64("id", "vec").alias("h")).distinct()
    # Written, so that its size is known before the vectors are sent anywhere.
    lengths = written(different.groupBy("model", "n").count().groupBy("model").agg(F.max_by("n", F.struct("count", "n")).alias("n")), "lengths")
    return parsed.where("vec is not null").join(lengths, ["model", "n"]).select("id", "model", "vec")


def nodes_of(vectors: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(id, node) of each of the usable vectors, once, and (node, model, vec, firsts) of each different one: firsts are the k + 1 smallest ids of its copies. The table of usable() is gone then."""
    keyed = vectors.withColumn("node", F.xxhash64("model", "vec"))
    members = written(keyed.select("id", "node").distinct(), "members")
    ranked = members.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1)
    firsts = ranked.groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("firsts"))
    once = keyed.dropDuplicates(["node"]).select("node", "model", "vec")
    return members, replaced(vectors, written(once.join(firsts, "node"), "nodes"))


def fit(rows: np.ndarray, blocks: int, rounds: int = 6) -> np.ndarray:
    """Centroids of unit vectors, by spherical k-means from a fixed seed."""
    rng = np.random.default_rng(5)
    centre = rows[rng.choice(len(rows), blocks, replace=False)].copy()
    for _ in range(rounds):
        nearest = (rows @ centre.T).argmax(axis=1)
        for b in range(blocks):
            mine = rows[nearest == b]
            if len(mine):
                m = mine.sum(axis=0)
                centre[b] = m / max(float(np.sqrt(m @ m)), 1e-12)
    return centre


def centroids(nodes: DataFrame) -> dict[str, np.ndarray]:
    """By model, of those that have more than a block of nodes; SAMPLE nodes in all, the first by a hash, come to the driver, so the least models may get none."""
    counts = nodes.groupBy("model").count().where(F.col("count") >= 2 * BLOCK).orderBy(F.desc("count"), "model").limit(SAMPLE // 64).collect()
    whole = sum(r["count"] for r in counts)
    share = {r.model: min(1.0, SAMPLE / whole) for r in counts if r["count"] * SAMPLE >= 64 * whole}
    if not share:
        return {}
    drawn = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = F.element_at(F.create_map(*[F.lit(x) for m, s in share.items() for x in (m, s)]), F.col("model"))
    out: dict[str, list[bytes]] = {m: [] for m in share}
    for r in nodes.where(drawn <= part).select("model", "vec").limit(2 * SAMPLE).collect():
        out[r.model].append(bytes(r.vec))
    sizes = {r.model: r["count"] for r in counts}
    made = {}
    for m, found in out.items():
        blocks = min(sizes[m] // BLOCK, len(found) // 16)
        if blocks > 1:
            made[m] = fit(np.frombuffer(b"".join(found), np.float32).reshape(len(found), -1), blocks)
    return made


def _assign(centres: dict[str, np.ndarray], each: int):
    """The nearest blocks of each node. A model without centroids is `each` blocks, which are the same but are halved in different ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = np.array(batch.column(1).to_pylist(), object)
            row, block = [], []
            for m in set(model.tolist()):
                at = np.flatnonzero(model == m)
                if m not in centres:
                    row.append(np.repeat(at, each))
                    block.append(np.tile(np.arange(each), len(at)))
                    continue
                v = np.frombuffer(b"".join(batch.column(2).take(pa.array(at)).to_pylist()), np.float32).reshape(len(at), -1)
                near = v @ centres[m].T
                a = min(each, near.shape[1])
                best = np.argpartition(-near, a - 1, axis=1)[:, :a] if a < near.shape[1] else np.tile(np.arange(a), (len(at), 1))
                row.append(np.repeat(at, a))
                block.append(best.ravel())
            rows = pa.array(np.concatenate(row) if row else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns], pa.array(np.concatenate(block) if block else [], pa.int32())], ["node", "model", "vec", "block"])

    return run


def _projected(levels: int, seed: int):
    """Where each node of a block lies along random directions, one for each level; a block has its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            block, vec = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            size = np.array([len(x) // 4 for x in vec], np.int64)
            out = np.zeros((len(vec), levels), np.float32)
            for b, d in set(zip(block.tolist(), size.tolist(), strict=True)):
                if (b, d) not in ways:
                    if len(ways) >= 256:
                        ways.clear()
                    ways[b, d] = np.random.default_rng((seed, b)).standard_normal((levels, d), np.float32)
                at = np.flatnonzero((block == b) & (size == d))
                out[at] = np.frombuffer(b"".join([vec[i] for i in at]), np.float32).reshape(len(at), d) @ ways[b, d].T
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(np.arange(len(vec) + 1) * levels, pa.int32()), pa.array(out.ravel()))], ["node", "model", "block", "way"])

    return run


def _halved(crowded: DataFrame, largest: int) -> DataFrame:
    """(node, model, block, cell): the nodes of (node, model, block, vec), of blocks of which none may be larger, each in a cell of its block.

    A cell that is too large is halved at the median of its nodes along a random direction, whatever the shape of the block, level by level; only
    ids and places along the directions are joined and written. Nodes that no direction tells apart are halved by a hash.
    """
    levels = 8
    seed = 0
    now = written(crowded.select("node", "model", "block", "vec").mapInArrow(_projected(levels, seed), "node bigint, model string, block int, way array<float>").withColumn("cell", F.lit(0).cast("bigint")), "cells")
    keys = ["model", "block", "cell"]
    while True:
        for i in range(levels):
            way = F.get("way", F.lit(i))
            cut = now.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx(way, 0.5, 1000).alias("middle"), F.min(way).alias("low"), F.max(way).alias("high")).where(F.col("n") > largest).drop("n")
            if not cut.limit(1).count():
                return now.select("node", "model", "block", "cell")
            right = F.when(F.col("low") == F.col("high"), F.pmod(F.xxhash64("node", "cell"), F.lit(2)) == 1).when(F.col("middle") == F.col("high"), way >= F.col("middle")).otherwise(way > F.col("middle"))
            cell = F.when(F.col("middle").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", right))
            now = replaced(now, written(now.join(cut, keys, "left").select("node", "model", "block", "way", cell.alias("cell")), "cells"))
        seed += 1
        vec = crowded.select("node", "model", "block", "vec").mapInArrow(_projected(levels, seed), "node bigint, model string, block int, way array<float>")
        now = replaced(now, written(now.drop("way").join(vec, ["node", "model", "block"]).select("node", "model", "block", "way", "cell"), "cells"))


def _block(kept: int):
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        n = len(node)
        v = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float32).reshape(n, -1)
        k = min(kept, n - 1)
        source, target, sims = [], [], []
        for at in range(0, n if k > 0 else 0, 512):
            s = v[at : at + 512] @ v.T
            own = np.arange(len(s))
            s[own, own + at] = -2
            best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(s), 1))
            source.append(np.repeat(node[at : at + 512], k))
            target.append(node[best].ravel())
            sims.append(np.take_along_axis(s, best, 1).ravel())
        empty = [np.empty(0)]
        return pa.table({"node": pa.array(np.concatenate(source or empty), pa.int64()), "to": pa.array(np.concatenate(target or empty), pa.int64()), "sim": pa.array(np.concatenate(sims or empty), pa.float32())})

    return run


def _best(edges: DataFrame, kept: int) -> DataFrame:
    """Of (node, to, sim, new): the best of each node, each neighbour once."""
    once = edges.repartition("node").groupBy("node", "to").agg(F.max("sim").alias("sim"), F.bool_and("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "to"))
    return once.withColumn("r", rank).where(F.col("r") <= kept).drop("r")


def _only_best(node: np.ndarray, to: np.ndarray, sim: np.ndarray, kept: int) -> np.ndarray:
    """Where the best `kept` of each node are, each neighbour once, of many proposals."""
    order = np.lexsort((-sim, to, node))
    n, t = node[order], to[order]
    order = order[np.concatenate([[True], (n[1:] != n[:-1]) | (t[1:] != t[:-1])])] if len(order) else order
    order = order[np.lexsort((to[order], -sim[order], node[order]))]
    n = node[order]
    begin = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])) if len(n) else np.empty(0, np.int64)
    rank = np.arange(len(n)) - np.repeat(begin, np.diff(np.append(begin, len(n))))
    return order[rank < kept]


def _introduce(kept: int):
    """Rows sorted by the introducing node: its neighbours, each with its 8-bit vector, its worst similarity and whether it is new. Pairs that beat either's worst come out, the best `kept` of each node, as it can take no more."""

    def pairs(table: pa.Table) -> pa.RecordBatch:
        via, node, worst, new = (table.column(c).to_numpy() for c in ("via", "node", "worst", "new"))
        vec = table.column("vec").to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(via)) + 1).tolist(), len(via)]
        a, b, sims = [], [], []
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e - s < 2 or not new[s:e].any():
                continue
            raw = b"".join(vec[s:e])
            if len(raw) % (e - s):
                continue
            v = np.frombuffer(raw, np.int8).reshape(e - s, -1).astype(np.float32)
            v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
            sim = v @ v.T
            fresh = new[s:e, None] | new[None, s:e]
            np.fill_diagonal(fresh, False)
            wanted = fresh & (sim > worst[s:e, None])
            if e - s > kept + 1:
                best = np.argpartition(np.where(wanted, -sim, 2), kept - 1, axis=1)[:, :kept]
                only = np.zeros_like(wanted)
                np.put_along_axis(only, best, True, axis=1)
                wanted &= only
            i, j = np.nonzero(wanted)
            a.append(node[s:e][i])
            b.append(node[s:e][j])
            sims.append(sim[i, j])
        if not sum(map(len, a)):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float32())], ["node", "to", "sim"])
        to_, from_, sim_ = np.concatenate(b), np.concatenate(a), np.concatenate(sims)
        # One node may be in very many lists: what all of them propose to it stays little. Nodes are hashes, so their bits tell that there is none such.
        if np.bincount(from_ & 0xFFFF).max() > 4 * kept:
            best = _only_best(from_, to_, sim_, kept)
            from_, to_, sim_ = from_[best], to_[best], sim_[best]
        return pa.RecordBatch.from_arrays([pa.array(from_, pa.int64()), pa.array(to_, pa.int64()), pa.array(sim_, pa.float32())], ["node", "to", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            via = table.column("via").to_numpy()
            if not len(via):
                continue
            cut = int(np.searchsorted(via, via[-1]))
            held = table.slice(cut)
            if cut:
                yield pairs(table.slice(0, cut))
        if held is not None and len(held):
            yield pairs(held)

    return run


def _eight_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw in batch.column(1).to_pylist():
            v = np.frombuffer(raw, np.float32)
            out.append(np.round(v * (127 / np.abs(v).max())).astype(np.int8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["node", "vec"])


def _parted(listed: DataFrame) -> DataFrame:
    """(via, node, new) of nodes that have a new neighbour; where there are more than PART, via stands for two of their parts, so that all meet but no task gets all."""
    over = Window.partitionBy("via")
    lively = listed.withColumn("parts", F.ceil(F.count("*").over(over) / F.lit(PART)).cast("int")).withColumn("lively", F.bool_or("new").over(over)).where("lively")
    part = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    # Only rows of crowded nodes become several.
    dealt = lively.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.when(F.col("parts") == 1, F.col("via")).otherwise(F.xxhash64("via", F.least("part", "other"), F.greatest("part", "other")))
    return dealt.select(key.alias("via"), "node", "new")


def start_of(nodes: DataFrame, kept: int = KEPT, each: int = BLOCKS_EACH, centres: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(node, to, sim, new): the first lists of (node, model, vec), from blocks of at most LARGEST nodes, written to the shared folder."""
    centres = centroids(nodes) if centres is None else centres
    placed = nodes.select("node", "model", "vec").mapInArrow(_assign(centres, each), "node bigint, model string, vec binary, block int")
    large = placed.groupBy("model", "block").count().where(F.col("count") > LARGEST).select("model", "block")
    placed = placed.withColumn("cell", F.lit(0).cast("bigint"))
    if large.limit(1).count():
        parted = _halved(placed.join(large, ["model", "block"], "left_semi"), LARGEST)
        others = placed.join(large, ["model", "block"], "left_anti").select("node", "model", "vec", "block", "cell")
        placed = others.unionByName(parted.join(nodes.select("node", "vec"), "node").select("node", "model", "vec", "block", "cell"))
    elif not centres:
        # All blocks of a small model are the same.
        placed = placed.where("block = 0")
    first = placed.groupBy("model", "block", "cell").applyInArrow(_block(kept), "node bigint, to bigint, sim float").withColumn("new", F.lit(True))
    return written(_best(first, kept), "graph")


def graph_of(nodes: DataFrame, kept: int = KEPT, each: int = BLOCKS_EACH, centres: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(node, to, sim, new): the neighbour graph of (node, model, vec), written to the shared folder.

    No nodes give an empty graph; a node alone in its model has no edges. No task gets a block that grows with the data (see _halved), nor all
    neighbours of a crowded node (see _parted); equal vectors are one node, so none is crowded by copies.
    """
    graph = start_of(nodes, kept, each, centres)
    small = written(nodes.select("node", "vec").mapInArrow(_eight_bits, "node bigint, vec binary"), "eightbit")
    tidied(nodes.sparkSession)
    # Lists only get better, so this ends.
    while True:
        graph = replaced(graph, improved(graph, small, kept))
        counted = graph.agg(F.count_if("new").alias("new"), F.count("*").alias("all")).first()
        # Spark holds on to what its last query shuffled; that is the count now, no longer the round.
        tidied(nodes.sparkSession)
        if counted["new"] <= ENOUGH * counted["all"]:
            return graph


def improved(graph: DataFrame, small: DataFrame, kept: int) -> DataFrame:
    """The graph after one round of introductions, written to the shared folder; small: (node, vec), the vectors in 8 bits."""
    worst = graph.groupBy("node").agg(F.when(F.count("*") >= kept, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    ways = graph.select(F.col("node").alias("via"), F.col("to").alias("node"), "new").unionByName(graph.select(F.col("to").alias("via"), "node", "new"))
    listed = _parted(ways.repartition("via").groupBy("via", "node").agg(F.bool_and("new").alias("new")))
    sent = listed.join(small.join(worst, "node"), "node").select("via", "node", "vec", "worst", "new")
    proposed = sent.repartition("via").sortWithinPartitions("via").mapInArrow(_introduce(kept), "node bigint, to bigint, sim float").withColumn("new", F.lit(True))
    return written(_best(graph.withColumn("new", F.lit(False)).unionByName(proposed), kept), "graph")


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sims = [float(np.frombuffer(x, np.float32).astype(np.float64) @ np.frombuffer(y, np.float32).astype(np.float64)) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sims, pa.float64())], ["way", "sim"])


def neighbours(passages: DataFrame, k: int = 10, least: float | None = None, key: str = "passage_id", model: str = "embedding_model", embedding: str = "embedding_json") -> DataFrame:
    """(id, rank, neighbour, similarity): the k most similar of every usable vector of the same model, best first, ties by the smaller id.

    Similarities are those of the vectors in double precision: the best RANKED edges of each node are computed anew before they are ranked. least: only neighbours
    at least so similar. Null keys, models and embeddings, incomplete JSON, zero vectors and ones of
    an unusual length give no rows; identical deliveries count once; a vector alone in its model has none. Of many equal vectors
    each has the k smallest other ids. The accuracy loss is in the graph: tests hold recall against brute force to 0.9 at least.
    """
    members, nodes = nodes_of(usable(passages, key, model, embedding), k)
    graph = graph_of(nodes)
    # Edges found in rounds have the cosine of 8-bit vectors, which was off by 0.007 at most where measured. Most edges go both ways and are computed once.
    if least is None:
        best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "to"))
        near = graph.withColumn("r", best).where(F.col("r") <= max(k, RANKED)).select("node", "to")
    else:
        near = graph.where(F.col("sim") >= least - 0.02).select("node", "to")
    ways = near.groupBy(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).agg(F.bool_or(F.col("node") < F.col("to")).alias("forth"), F.bool_or(F.col("node") > F.col("to")).alias("back"))
    both = ways.join(nodes.select(F.col("node").alias("a"), "vec"), "a").join(nodes.select(F.col("node").alias("b"), F.col("vec").alias("vec2")), "b")
    scored = both.select(F.struct("a", "b", "forth", "back").alias("way"), "vec", "vec2").mapInArrow(_exact, "way struct<a:bigint,b:bigint,forth:boolean,back:boolean>, sim double")
    if least is not None:
        scored = scored.where(F.col("sim") >= least)
    ends = F.array_compact(F.array(F.when(F.col("way.forth"), F.struct(F.col("way.a").alias("node"), F.col("way.b").alias("to"))), F.when(F.col("way.back"), F.struct(F.col("way.b").alias("node"), F.col("way.a").alias("to")))))
    edges = scored.select(F.explode(ends).alias("e"), "sim").select("e.node", "e.to", "sim")
    offered = edges.join(nodes.select(F.col("node").alias("to"), F.col("firsts").alias("theirs")), "to")
    listed = offered.groupBy("node").agg(F.flatten(F.collect_list(F.transform("theirs", lambda i: F.struct((-F.round("sim", 6)).alias("d"), i.alias("id"))))).alias("others"))
    own = nodes.select("node", F.transform("firsts", lambda i: F.struct(F.lit(-1.0).alias("d"), i.alias("id"))).alias("own")).join(listed, "node", "left")
    every = F.array_sort(F.concat("own", F.coalesce("others", F.array().cast("array<struct<d:double,id:string>>"))))
    best = own.select("node", every.alias("every"))
    found = members.join(best, "node").select("id", F.posexplode(F.slice(F.filter("every", lambda x: x["id"] != F.col("id")), 1, k)).alias("pos", "x"))
    return found.select("id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("neighbour"), (-F.col("x.d")).alias("similarity"))


def pairs(passages: DataFrame, least: float = 0.9, k: int = 10) -> DataFrame:
    """(passage_id_a, passage_id_b): pairs at least so similar of which one is among the other's k most similar, the smaller id first."""
    found = neighbours(passages, k, least)
    return found.select(F.least("id", "neighbour").alias("passage_id_a"), F.greatest("id", "neighbour").alias("passage_id_b")).distinct()


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs_ = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        sims = [float(np.frombuffer(x, np.float32) @ np.frombuffer(y, np.float32)) if len(x) == len(y) else -2.0 for x, y in pairs_]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float32())], ["query", "node", "sim"])


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, centres: dict[str, np.ndarray], k: int = 10, beam: int = 32, hops: int = 12, seeds: int = 8) -> DataFrame:
    """(query, node, sim): about the k most similar nodes of each of (query, model, vec), by greedy search in the graph.

    Each query starts from `seeds` nodes of each of its nearest blocks; in each hop the neighbours of the best nodes that haven't been
    visited are looked at, and the `beam` best of all are kept, until nothing changes or `hops` are done. Edges are followed both ways.
    """
    where = nodes.select("node", "model", "vec").mapInArrow(_assign(centres, 1), "node bigint, model string, vec binary, block int")
    start = where.withColumn("r", F.row_number().over(Window.partitionBy("model", "block").orderBy(F.xxhash64("node")))).where(F.col("r") <= seeds).select("model", "block", "node")
    asked = queries.select(F.col("query").alias("node"), "model", "vec").mapInArrow(_assign(centres, BLOCKS_EACH), "node bigint, model string, vec binary, block int")
    ways = graph.select("node", "to").unionByName(graph.select(F.col("to").alias("node"), F.col("node").alias("to"))).distinct()
    by_query, vectors = queries.select("query", F.col("vec").alias("q")), nodes.select("node", "vec")

    def scored(pairs_: DataFrame) -> DataFrame:
        return pairs_.join(by_query, "query").join(vectors, "node").select("query", "node", "q", "vec").mapInArrow(_dots, "query bigint, node bigint, sim float")

    order = Window.partitionBy("query").orderBy(F.desc("sim"), "node")
    first = asked.select(F.col("node").alias("query"), "model", "block").join(start, ["model", "block"]).select("query", "node").distinct()
    now = written(scored(first).withColumn("seen", F.lit(False)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= beam), "hop")
    for _ in range(hops):
        next_ = now.where(~F.col("seen")).select("query", "node").join(ways, "node").select("query", F.col("to").alias("node")).distinct()
        fresh = scored(next_.join(now.select("query", "node"), ["query", "node"], "left_anti")).withColumn("seen", F.lit(False))
        after = now.select("query", "node", "sim").withColumn("seen", F.lit(True)).unionByName(fresh).withColumn("r", F.row_number().over(order)).where(F.col("r") <= beam)
        now = written(after, "hop")
        if not now.where(~F.col("seen")).limit(1).count():
            break
    return now.where(F.col("r") <= k).select("query", "node", "sim")
