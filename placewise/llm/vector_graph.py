"""Nearest neighbours by inner product over robust-pruned directed graphs.

Distinct vectors are dealt by hash into shards; a task builds the graph of one
shard.  Vectors get one more component, which makes them equally long, so that
the largest inner product is the least distance.  Nodes enter in batches of
doubling size: a greedy search from the middle node proposes neighbours for
each, pruning keeps a candidate only if no kept one is nearer to it by the
factor ``ALPHA``, and edges are entered backwards too.  A beam search asks
every shard; the best of all shards are ranked by the inner product of the
original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewise.llm.common import ship, written
from placewise.operators.common import hot_keys, partitions_of, skew_join

#: Distinct vectors of one shard, about, and query vectors that meet a shard in one task.
SHARD_ROWS, QUERY_ROWS = 16_384, 65_536
#: Queries for which a further copy of a graph is worth its shuffle, where cores would be idle without.
WORTH_A_COPY = 1024
#: Bytes of the vectors of one shard, about, counted as doubles.
SHARD_BYTES = 64 << 20
#: Edges that pruning leaves to a node, edges it may have before it is pruned, nodes held by a search while building
#: and while asking, and the relaxed distance.
EDGES, ROOM, BUILD_BEAM, BEAM, ALPHA = 24, 40, 64, 128, 1.2
#: Nodes that enter, and queries that walk, at once, fewer where vectors are longer than LENGTH; nodes a walk opens in a step.
BATCH, LENGTH = 256, 64
OPENED = 4
FAR = np.float32(-np.inf)


# -- one graph ----------------------------------------------------------------------


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``a`` (m, d) with ``b`` (m, k, d); the larger, the nearer, as all points are equally long."""
    return np.matmul(b, a[:, :, None])[:, :, 0]


class Graph:
    """A directed graph over the rows of ``points``, all equally long; row ``ROOM`` wide, -1 where a node has fewer edges."""

    def __init__(self, points: np.ndarray, edges: np.ndarray | None = None, start: int = 0) -> None:
        self.points = points
        self.edges = np.full((len(points), ROOM), -1, dtype=np.int32) if edges is None else edges
        self.start = start
        self.batch = max(8, min(BATCH, BATCH * LENGTH // max(points.shape[1], 1)))

    def walk(self, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search: (nodes, nearness), nearest first, ``width`` per asked row; -1 and -inf fill up.

        Each step opens the ``OPENED`` nearest nodes not yet opened.
        """
        m, n = len(asked), len(self.points)
        seen = np.zeros((m, n + 1), dtype=bool)
        nodes = np.full((m, width), -1, dtype=np.int32)
        near = np.full((m, width), FAR)
        opened = np.zeros((m, width), dtype=bool)
        nodes[:, 0], seen[:, self.start] = self.start, True
        near[:, 0] = asked @ self.points[self.start]
        active = np.arange(m)
        while True:
            waiting = ~opened[active] & (nodes[active] >= 0)
            going = waiting.any(axis=1)
            active, waiting = active[going], waiting[going]
            if not len(active):
                return nodes, near
            waiting &= np.cumsum(waiting, axis=1) <= OPENED
            opened[active] |= waiting
            # The nodes to open, -1 where a row has fewer of them.
            at = np.full((len(active), OPENED), -1, dtype=np.int32)
            row, place = np.nonzero(waiting)
            at[row, np.cumsum(waiting, axis=1)[row, place] - 1] = nodes[active[row], place]
            found = np.where(at[:, :, None] >= 0, self.edges[at], -1).reshape(len(active), -1)
            if OPENED > 1:  # one node may be a neighbour of several
                found = np.sort(found, axis=1)
                found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            fresh = (found >= 0) & ~seen[active[:, None], found]
            seen[active[:, None], np.where(fresh, found, n)] = True
            gain = np.where(fresh, _near(asked[active], self.points[found]), FAR)
            some = gain.max(axis=1) > near[active, -1]
            rows, found, gain = active[some], found[some], gain[some]
            if len(rows):
                merged = np.concatenate([near[rows], gain], axis=1)
                best = np.argpartition(-merged, width - 1, axis=1)[:, :width]
                order = np.take_along_axis(best, np.argsort(-np.take_along_axis(merged, best, axis=1), axis=1), axis=1)
                near[rows] = np.take_along_axis(merged, order, axis=1)
                nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], found], axis=1), order, axis=1)
                opened[rows] = np.take_along_axis(np.concatenate([opened[rows], np.zeros_like(found, dtype=bool)], axis=1), order, axis=1)
                nodes[rows] = np.where(np.isinf(near[rows]), -1, nodes[rows])

    def pruned(self, nodes: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Kept edges of ``nodes`` (m) out of the candidates ``near`` (m, k; -1: none)."""
        near = np.where(near == nodes[:, None], -1, near)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        own = self.points[nodes]
        square = np.einsum("md,md->m", own, own)[:, None]
        points = self.points[near]
        dist = np.where(near >= 0, np.maximum(2 * (square - _near(own, points)), 0), -FAR)
        order = np.argsort(dist, axis=1)
        near, dist = np.take_along_axis(near, order, axis=1), np.take_along_axis(dist, order, axis=1)
        points = np.take_along_axis(points, order[:, :, None], axis=1)
        between = 2 * (square[:, :, None] - np.matmul(points, points.transpose(0, 2, 1)))
        kept = np.full((len(nodes), ROOM), -1, dtype=np.int32)
        left, every = np.isfinite(dist), np.arange(len(nodes))
        for slot in range(EDGES):
            pick = left.argmax(axis=1)
            some = left[every, pick]
            if not some.any():
                break
            kept[some, slot] = near[some, pick[some]]
            left[every, pick] = False
            # Distances are squared, so is the factor.
            left &= ~(some[:, None] & (ALPHA**2 * between[every, pick] <= dist))
        return kept

    def enter(self, nodes: np.ndarray) -> None:
        """Gives new ``nodes`` their edges, and those they point to an edge back."""
        near, _ = self.walk(self.points[nodes], BUILD_BEAM)
        self.edges[nodes] = kept = self.pruned(nodes, near)
        source, target = np.repeat(nodes, ROOM), kept.reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        ends, first, counts = np.unique(target, return_index=True, return_counts=True)
        # A node pointed at by very many of a batch takes them in turns of EDGES.
        for turn in range(0, int(counts.max(initial=0)), EDGES):
            some = counts > turn
            to, at, size = ends[some], first[some] + turn, np.minimum(counts[some] - turn, EDGES)
            spots = at[:, None] + np.arange(int(size.max()))
            inside = np.arange(int(size.max())) < size[:, None]
            back = np.where(inside, source[np.minimum(spots, len(source) - 1)], -1).astype(np.int32)
            both = -np.sort(-np.concatenate([self.edges[to], back], axis=1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            full = (both >= 0).sum(axis=1) > ROOM
            self.edges[to[~full]] = -np.sort(-both[~full], axis=1)[:, :ROOM]
            for low in range(0, int(full.sum()), self.batch):
                part = to[full][low : low + self.batch]
                self.edges[part] = self.pruned(part, both[full][low : low + self.batch])


def levelled(vectors: np.ndarray) -> np.ndarray:
    """The vectors with one more component that makes all equally long."""
    square = np.einsum("nd,nd->n", vectors, vectors)
    return np.concatenate([vectors, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], axis=1).astype(np.float32)


def build(vectors: np.ndarray) -> Graph:
    """The graph of one shard: nodes in random order, batches doubling up to a fixed size."""
    points = levelled(vectors.astype(np.float64))
    middle = (points @ points.mean(axis=0, dtype=np.float64).astype(np.float32)).argmax()
    graph = Graph(points, start=int(middle))
    order = np.random.default_rng(0).permutation(len(points))
    order = np.concatenate([[middle], order[order != middle]])
    done = 1
    while done < len(order):
        batch = order[done : done + min(done, graph.batch)]
        graph.enter(batch)
        done += len(batch)
    return graph


def ask(graph: Graph, vectors: np.ndarray, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes near to each asked row, -1 where there are fewer, and their inner products in double precision."""
    if len(vectors) <= width:  # the whole shard fits into the beam
        nodes = np.broadcast_to(np.arange(len(vectors)), (len(asked), len(vectors)))
    else:
        level = np.concatenate([asked, np.zeros((len(asked), 1))], axis=1).astype(np.float32)
        nodes = graph.walk(level, width)[0]
    score = np.einsum("md,mkd->mk", asked, vectors[nodes])
    return nodes, np.where(nodes >= 0, score, -np.inf)


# -- tables -------------------------------------------------------------------------

_GRAPH = "dim int, shard long, vectors binary, ids binary, counts binary, edges binary, start long"


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate([np.zeros((0, dim)), *[np.asarray(r, dtype=np.float64)[None] for r in rows]])


def _build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["k1", "k2"])
    vectors = _matrix(rows["vec"], key[0])
    graph = build(vectors)
    ids = np.concatenate([np.asarray(i, dtype=np.int64) for i in rows["ids"]])
    blobs = (vectors, ids, np.array([len(i) for i in rows["ids"]], dtype=np.int64), graph.edges)
    return pd.DataFrame([(*key, *[b.tobytes() for b in blobs], graph.start)], columns=[c.split()[0] for c in _GRAPH.split(", ")])


def _ask_shard(k: int, width: int):
    def run(key: tuple, shards: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(shards) and len(asked):
            shard, dim = shards.iloc[0], key[0]
            vectors = np.frombuffer(shard["vectors"], dtype=np.float64).reshape(-1, dim)
            ids, counts = (np.frombuffer(shard[c], dtype=np.int64) for c in ("ids", "counts"))
            ends = np.cumsum(counts)
            edges = np.frombuffer(shard["edges"], dtype=np.int32).reshape(len(vectors), ROOM)
            graph = Graph(levelled(vectors), edges, int(shard["start"]))
            for low in range(0, len(asked), graph.batch):
                part = asked.iloc[low : low + graph.batch]
                nodes, scores = ask(graph, vectors, _matrix(part["vec"], dim), width)
                for k1, k2, node, score in zip(part["k1"], part["k2"], nodes, scores, strict=True):
                    node, score = node[node >= 0], score[node >= 0]
                    # All members of a vector score alike: those of the best vectors are ranked by id.
                    best = score >= np.sort(score)[::-1][: k][-1]
                    node, score = node[best], score[best]
                    member = np.concatenate([ids[ends[v] - counts[v] : ends[v]] for v in node])
                    score = np.repeat(score, counts[node])
                    order = np.lexsort((member, -score))[:k]
                    found.append(pd.DataFrame({"k1": k1, "k2": k2, "vec_id": member[order], "score": score[order]}))
        columns = ["k1", "k2", "vec_id", "score"]
        return pd.concat(found) if found else pd.DataFrame(columns=columns)

    return run


def usable(embedding: Column) -> Column:
    """True for vectors that take part: with components, all finite, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def index(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """(distinct vectors, graphs, shards) of ``rows`` (id, k1, k2, vec); every vector is in one graph.

    A vector keeps its ``k`` least ids: no answer of ``k`` rows can hold more of them.
    """
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    ids = rows.select("k1", "k2", "id").distinct().withColumn("_place", place).where(F.col("_place") <= k)
    ids = ids.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    vectors = written(
        rows.groupBy("k1", "k2").agg(F.first("vec").alias("vec")).join(ids, ["k1", "k2"]).withColumn("dim", F.size("vec")), "vectors"
    )
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum("dim"), F.lit(0)).alias("d")).first()
    shards = max(1, -(-size["n"] // SHARD_ROWS), -(-8 * size["d"] // SHARD_BYTES))
    dealt = ship(vectors).withColumn("shard", F.pmod("k1", F.lit(shards)))
    return vectors, written(dealt.groupBy("dim", "shard").applyInPandas(_build_shard, _GRAPH), "vector-graphs"), shards


def nearest(vectors: DataFrame, asks: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", width: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest inner product found for each row where ``asks`` holds.

    Rows without an id, and vectors that are null, empty, zero or hold null or
    infinite components or no numbers, take no part.  Only vectors of the
    query's length are its candidates.  Rows alike in id and vector count once;
    a query's own row is no candidate.  Equal scores go to the lesser id; with
    fewer candidates all are returned; an empty table gives no row.
    """
    vec = F.col("vec")
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec"), F.coalesce(asks, F.lit(False)).alias("asks")
    ).where(F.col("id").isNotNull() & usable(vec))
    rows = rows.select("id", "vec", "asks", F.xxhash64(F.lit(1), vec).alias("k1"), F.xxhash64(F.lit(2), vec).alias("k2"))
    # One row more than asked for, as a query's own row may be among them.
    every, graphs, shards = index(rows, k + 1)
    queries = written(rows.where("asks").select(F.col("id").alias("query_id"), "k1", "k2").distinct(), "queries")
    copies = queries.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    asked = every.join(copies.select("k1", "k2"), ["k1", "k2"], "left_semi").select("k1", "k2", "dim", "vec")
    # Equal vectors are asked for once.  Blocks bound what a task gets; few queries make few blocks, as each gets the graph.
    n, cores = copies.count(), partitions_of(vectors.sparkSession)
    blocks = max(1, -(-n // QUERY_ROWS), min(-(-cores // shards), -(-n // WORTH_A_COPY)))
    blocked = asked.withColumn("block", F.pmod("k2", F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    served = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = served.groupBy("dim", "shard", "block").cogroup(blocked.groupBy("dim", "shard", "block"))
    found = met.applyInPandas(_ask_shard(k + 1, width), "k1 long, k2 long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("_place", place).where(F.col("_place") <= k + 1)
    best = written(
        best.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("found")), "nearest"
    )
    answered = skew_join(queries, best, ["k1", "k2"], hot=hot_keys(copies, ["k1", "k2"]))
    others = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    listed = answered.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "one"))
    return listed.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "one.vec_id", (-F.col("one.less")).alias("score"))
