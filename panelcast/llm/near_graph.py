"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard of vectors.

Equal vectors are one node.  Nodes are dealt to shards of a bounded size by a hash of the vector.  In
a shard, greedy searches of the graph so far propose neighbours of new nodes; of these the nearest is
kept again and again, and those that it is much nearer to than the node itself are dropped, so the
edges kept point in different directions.  A query walks the graph of every shard with a beam; the
beam's nodes are measured in double precision on the original vectors, and the shards' best meet.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelcast.llm.common import settle

SHARD_ROWS = 8192
#: Queries that one task searches a shard for.
QUERY_BLOCK = 4096
DEGREE = 32
#: An edge is dropped if a kept one leads ALPHA times nearer to its end.
ALPHA = 1.2
BUILD_BEAM = 64
SEARCH_BEAM = 128
#: Nodes a beam opens at once, nodes it starts from, and nodes the graph begins with.
OPENED = 4
ENTRIES = 16
SEEDS = 128
#: Nodes inserted at once, nodes pruned at once, proposals looked at.
BATCH = 512
PRUNE_BATCH = 256
PROPOSALS = 128


def scaled(vectors: list) -> np.ndarray:
    """Vectors of one length in double precision, each times a power of two, so that no square of a
    component overflows and no bit of the cosine changes."""
    x = np.array(vectors, dtype=np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=1e-300))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int):
    """(ids, similarities) of the ``beam`` nodes that each query's walk found nearest, nearest first;
    -1 where the graph has fewer.  ``edges`` holds a node's neighbours, -1 behind them."""
    beam = max(beam, len(entries))
    n, width = len(queries), OPENED * edges.shape[1]
    ids = np.full((n, beam), -1, dtype=np.int64)
    near = np.full((n, beam), -np.inf, dtype=np.float32)
    opened = np.ones((n, beam), dtype=bool)
    seen = np.full((n, len(points)), -1, dtype=np.int16)
    near[:, : len(entries)] = queries @ points[entries].T
    ids[:, : len(entries)], opened[:, : len(entries)], seen[:, entries] = entries, False, 0
    live = np.arange(n)
    while len(live):
        by = np.argsort(-near[live], axis=1, kind="stable")
        ids[live] = np.take_along_axis(ids[live], by, 1)
        near[live] = np.take_along_axis(near[live], by, 1)
        shut = np.take_along_axis(opened[live], by, 1)
        next_up = ~shut & (np.cumsum(~shut, axis=1) <= OPENED)
        opened[live] = shut | next_up
        busy = next_up.any(1)
        live, next_up = live[busy], next_up[busy]
        if not len(live):
            break
        row, at = np.nonzero(next_up)
        place = np.cumsum(next_up, axis=1)[row, at] - 1
        ahead = np.full((len(live), OPENED, edges.shape[1]), -1, dtype=np.int64)
        ahead[row, place] = edges[ids[live[row], at]]
        ahead = ahead.reshape(len(live), width)
        row, at = np.nonzero(ahead >= 0)
        node = ahead[row, at]
        new = seen[live[row], node] < 0
        row, at, node = row[new], at[new], node[new]
        # Of a node that two opened ones lead to, the place written last stands.
        seen[live[row], node] = at
        new = seen[live[row], node] == at
        row, at, node = row[new], at[new], node[new]
        found = np.full((len(live), width), -np.inf, dtype=np.float32)
        found[row, at] = np.einsum("ij,ij->i", queries[live[row]], points[node])
        all_near = np.concatenate([near[live], found], axis=1)
        all_ids = np.concatenate([ids[live], ahead], axis=1)
        all_shut = np.concatenate([opened[live], np.isneginf(found)], axis=1)
        top = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
        near[live] = np.take_along_axis(all_near, top, 1)
        ids[live] = np.where(np.isneginf(near[live]), -1, np.take_along_axis(all_ids, top, 1))
        opened[live] = np.take_along_axis(all_shut, top, 1)
    return ids, near


def robust_prune(points: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, degree: int, alpha: float, force: bool = True):
    """Edges (len(nodes), degree) chosen from the proposals of each node, -1 where there are none.

    The nearest proposal is taken; then all go that are ``alpha`` times nearer to it than to the node;
    and again.  Without ``force`` a node with no more proposals than edges keeps them all.
    """
    out = np.full((len(nodes), degree), -1, dtype=np.int64)
    for start in range(0, len(nodes), PRUNE_BATCH):
        me, cand = nodes[start : start + PRUNE_BATCH], np.sort(proposed[start : start + PRUNE_BATCH], axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == me[:, None]] = -1
        mine = np.einsum("icj,ij->ic", points[cand], points[me])
        mine[cand < 0] = -np.inf
        by = np.argsort(-mine, axis=1, kind="stable")[:, :PROPOSALS]
        cand, apart = np.take_along_axis(cand, by, 1), 2 - 2 * np.take_along_axis(mine, by, 1)
        x = points[cand]
        between = 2 - 2 * (x @ x.transpose(0, 2, 1))
        alive, rows = cand >= 0, np.arange(len(me))
        whole = np.zeros(len(me), bool) if force else alive.sum(1) <= degree
        for i in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            first = alive.argmax(1)
            out[start + rows[some], i] = cand[some, first[some]]
            alive[rows, first] = False
            alive &= whole[:, None] | (alpha * alpha * between[rows, first] > apart)
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM) -> np.ndarray:
    """Edges of the graph over unit vectors: batches of nodes, each at most as large as the graph so
    far, search it, are joined to what they found, and are offered to their new neighbours."""
    n = len(points)
    edges = np.full((n, degree), -1, dtype=np.int64)
    seeds = min(n, SEEDS)
    first = np.arange(seeds)
    edges[:seeds] = robust_prune(points, first, np.tile(first, (seeds, 1)), degree, alpha)
    at = seeds
    while at < n:
        batch = np.arange(at, min(n, at + min(at, BATCH)))
        found, _ = beam_search(points[:at], edges[:at], points[batch], np.arange(min(ENTRIES, at)), beam)
        # Nodes of one batch do not see each other in the graph yet: each is also shown its nearest.
        inside = points[batch] @ points[batch].T
        np.fill_diagonal(inside, -np.inf)
        close = min(len(batch) - 1, degree // 2)
        if close > 0:
            found = np.concatenate([found, batch[np.argpartition(-inside, close - 1, axis=1)[:, :close]]], axis=1)
        edges[batch] = robust_prune(points, batch, found, degree, alpha)
        _offer_back(points, edges, batch, degree, alpha)
        at = batch[-1] + 1
    return edges


def _offer_back(points: np.ndarray, edges: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Every new edge is offered to its end the other way round."""
    source, end = np.repeat(batch, degree), edges[batch].reshape(-1)
    source, end = source[end >= 0], end[end >= 0]
    by = np.argsort(end, kind="stable")
    source, end = source[by], end[by]
    nodes, start, count = np.unique(end, return_index=True, return_counts=True)
    # Nodes with about as many offers are pruned together, so that no padding is long.
    size = np.ceil(np.log2(count)).astype(int)
    for s in np.unique(size):
        some = np.flatnonzero(size == s)
        offered = np.full((len(some), 1 << int(s)), -1, dtype=np.int64)
        for i in range(offered.shape[1]):
            has = count[some] > i
            offered[has, i] = source[start[some[has]] + i]
        told = np.concatenate([edges[nodes[some]], offered], axis=1)
        edges[nodes[some]] = robust_prune(points, nodes[some], told, degree, alpha, force=False)


def _sound(df: DataFrame, name: str) -> DataFrame:
    """(name, embedding, h1, h2) of the rows whose vector can be compared, repeated ones once."""
    e = F.col("embedding").cast("array<double>")
    finite = ~F.exists(e, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    sound = F.col(name).isNotNull() & finite & F.exists(e, lambda c: c != 0)
    rows = df.filter(F.coalesce(sound, F.lit(False))).select(F.col(name).cast("long").alias(name), e.alias("embedding"))
    return rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})


def build(df: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, degree: int = DEGREE) -> DataFrame:
    """The index of (vec_id, embedding): dims, shard, node, ids, embedding and edges of every distinct
    vector, as a written table.

    ids are the k + 1 smallest of the vector's vec_ids; no answer of k rows without the query's own
    can hold others.  Shards hold about ``shard_rows`` vectors of one length.  Rows without vec_id and
    vectors that are null, empty, zero or hold null or non-finite components have no node.
    """
    good = _sound(df, "vec_id")
    by_id = Window.partitionBy("h1", "h2").orderBy("vec_id")
    ids = good.select("h1", "h2", "vec_id").distinct().withColumn("rank", F.row_number().over(by_id))
    ids = ids.filter(F.col("rank") <= k + 1).groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    vectors = good.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"))
    nodes = settle(vectors.join(ids, ["h1", "h2"]).withColumn("dims", F.size("embedding")))
    shards = max(1, ceil(nodes.count() / shard_rows))

    def run(key, table):
        table = table.sort_by([("h1", "ascending"), ("h2", "ascending")])  # any order, but always the same
        points = unit(scaled(table.column("embedding").to_pylist()))
        edges = build_graph(points, degree)
        n = table.num_rows
        return pa.table({
            "dims": pa.array([key[0].as_py()] * n, pa.int32()), "shard": pa.array([key[1].as_py()] * n, pa.int64()),
            "node": pa.array(np.arange(n), pa.int32()), "ids": table.column("ids"), "embedding": table.column("embedding"),
            "edges": pa.array([e[e >= 0].tolist() for e in edges], pa.list_(pa.int32())),
        })

    dealt = nodes.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("dims", "shard")
    return settle(dealt.applyInArrow(run, "dims int, shard long, node int, ids array<long>, embedding array<double>, edges array<int>"))


def search(index: DataFrame, queries: DataFrame, k: int = 5, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of (query_id, embedding).

    Nearness is the cosine in double precision; ties go to the smaller vec_id.  Rows of the query's own
    id are no answer.  Vectors are compared with those of their length.  A query id with several
    different vectors is answered for each of them.  Queries without an id or with a vector that cannot
    be compared are not answered.  Every shard is searched for all queries, in blocks of QUERY_BLOCK.
    """
    asked = settle(_sound(queries, "query_id").dropDuplicates(["query_id", "h1", "h2"]).withColumn("dims", F.size("embedding")))
    blocks = max(1, ceil(asked.count() / QUERY_BLOCK))
    last = index.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]
    block = F.pmod(F.xxhash64("query_id", "h1"), F.lit(blocks)).cast("int")
    sent = asked.withColumns({"block": block, "shard": F.explode(F.sequence(F.lit(0), F.lit(last)))})
    sent = sent.withColumn("shard", F.col("shard").cast("long"))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(nodes: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if nodes.num_rows and wanted.num_rows:
            nodes = nodes.sort_by("node")
            x, ids, neighbours = (scaled(nodes.column("embedding").to_pylist()), *(nodes.column(c).to_pylist() for c in ("ids", "edges")))
            edges = np.full((len(x), max(1, max(map(len, neighbours)))), -1, dtype=np.int64)
            for i, e in enumerate(neighbours):
                edges[i, : len(e)] = e
            points, norm = unit(x), np.sqrt((x * x).sum(1))
            entries = np.arange(min(ENTRIES, len(x)))
            wanted = wanted.sort_by([("query_id", "ascending"), ("h1", "ascending")])
            for at in range(0, wanted.num_rows, BATCH):
                part = wanted.slice(at, BATCH)
                q = scaled(part.column("embedding").to_pylist())
                found, _ = beam_search(points, edges, unit(q), entries, beam)
                row, place = np.nonzero(found >= 0)
                node = found[row, place]
                score = (q[row] * x[node]).sum(1) / (np.sqrt((q * q).sum(1))[row] * norm[node])
                order = np.lexsort((-score, row))
                own, h1, h2 = (part.column(c).to_pylist() for c in ("query_id", "h1", "h2"))
                best: dict[int, list[tuple[float, int]]] = {}
                for r, n, s in zip(row[order].tolist(), node[order].tolist(), score[order].tolist()):
                    mine = best.setdefault(r, [])
                    # Nodes of the same score are all looked at, since their ids decide.
                    if len(mine) < k or s == mine[-1][0]:
                        mine += [(s, i) for i in ids[n] if i != own[r]]
                for r, mine in best.items():
                    for s, i in sorted(mine, key=lambda m: (-m[0], m[1]))[:k]:
                        for column, value in zip(out, (own[r], h1[r], h2[r], i, s)):
                            column.append(value)
        kinds = [pa.int64()] * 4 + [pa.float64()]
        names = ["query_id", "h1", "h2", "vec_id", "score"]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    by = ["dims", "shard", "block"]
    found = held.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(
        run, "query_id long, h1 long, h2 long, vec_id long, score double"
    )
    nearest = Window.partitionBy("query_id", "h1", "h2").orderBy(F.desc("score"), "vec_id")
    rank = F.row_number().over(nearest)
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(df: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest found of every vector whose vec_id is divisible by ``every``, among all vectors of
    (vec_id, embedding); other columns of df do not matter, and an empty table gives an empty one."""
    queries = df.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return search(build(df, k), queries, k)
