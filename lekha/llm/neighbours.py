"""Approximate nearest neighbours: one HNSW graph per shard, results merged.

Distinct vectors are dealt to shards of bounded size by hash. A shard's graph
has the usual layers: a node's top layer is drawn geometrically, its links in
a layer are the candidates that lie nearer to it than to any link chosen
before, links run both ways up to a cap. As shards are bounded, candidates
come from exact blocked distances instead of a search per insertion. Graphs
are flat neighbour arrays. All queries of a block walk a graph in lockstep;
distances of what they find are computed anew in double precision.

Cases: vectors that are null, empty, zero, or hold null or non-finite parts
take no part; only vectors of equal dimension meet; equal vectors are indexed
once with the smallest ids that any query can return; repeated rows count
once; fewer candidates than asked for are all returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

SHARD, QUERIES, M, CANDIDATES, BEAM = 4096, 2048, 16, 48, 64
INDEX = "dim int, shard int, ids array<array<bigint>>, vectors binary, layers array<binary>, members array<binary>"


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def _linked(x: np.ndarray, cap: int) -> np.ndarray:
    """Neighbour array of one layer over the rows of x, -1 where there is none."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    chosen = np.full((n, M), -1, np.int32)
    if k > 0:
        for start in range(0, n, 256):
            rows = np.arange(start, min(n, start + 256))
            d = _distances(x[rows], x)
            d[np.arange(len(rows)), rows] = np.inf
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            dist = np.take_along_axis(d, near, 1)
            order = np.argsort(dist, axis=1, kind="stable")
            near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
            c = x[near]
            among = (c * c).sum(2)[:, :, None] + (c * c).sum(2)[:, None, :] - 2 * np.einsum("ijk,ilk->ijl", c, c)
            taken = np.zeros(near.shape, bool)
            count = np.zeros(len(rows), np.int64)
            for j in range(k):
                free = (~taken[:, :j] | (among[:, j, :j] > dist[:, j, None])).all(1) & (count < M)
                taken[free, j] = True
                chosen[rows[free], count[free]] = near[free, j]
                count[free] += 1
    src, slot = np.nonzero(chosen >= 0)
    dst = chosen[src, slot].astype(np.int64)
    pair = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    a, b = pair // max(1, n), pair % max(1, n)
    order = np.lexsort((((x[a] - x[b]) ** 2).sum(1), a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, cap), -1, np.int32)
    keep = place < cap
    out[a[keep], place[keep]] = b[keep]
    return out


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("h", kind="stable")
    x = np.stack(rows["v"].to_numpy()).astype(np.float32)
    rng = np.random.default_rng(int(key[1]))
    level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(M)).astype(int)
    layers, members = [], []
    for at in range(int(level.max()) + 1):
        own = np.flatnonzero(level >= at)
        layers.append(_linked(x[own], 2 * M if at == 0 else M).tobytes())
        members.append(own.astype(np.int32).tobytes())
    return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "ids": [[list(i) for i in rows["ids"]]],
                         "vectors": [x.tobytes()], "layers": [layers], "members": [members]})


def _walk(q: np.ndarray, x: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int) -> np.ndarray:
    """Best ``beam`` nodes of one layer for every query, from its entry nodes; -1 where there are fewer."""
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True  # where -1 points
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.zeros((n, beam), bool)
    new = entry
    active = np.arange(n)
    while len(active):
        fresh = (new >= 0) & ~seen[active[:, None], new]
        seen[active[:, None], np.where(fresh, new, len(x))] = True
        d = np.where(fresh, ((x[new] - q[active][:, None]) ** 2).sum(2), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[active], d], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[active] = np.take_along_axis(all_d, order, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, new, -1)], 1), order, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(d.shape, bool)], 1), order, 1)
        open_ = ~done & (ids >= 0) & np.isfinite(dist)
        active = np.flatnonzero(open_.any(1))
        at = open_[active].argmax(1)
        done[active, at] = True
        new = links[ids[active, at]].astype(np.int64)
    return np.where(np.isfinite(dist), ids, -1)


def _search(k: int):
    def run(frames):
        for frame in frames:
            for r in frame.itertuples():
                x = np.frombuffer(r.vectors, np.float32).reshape(-1, r.dim)
                q = np.frombuffer(r.query_vectors, np.float32).reshape(-1, r.dim)
                names = np.frombuffer(r.query_ids, np.int64)
                found = None
                for links, own in list(zip(r.layers, r.members))[::-1]:
                    own = np.frombuffer(own, np.int32)
                    links = np.frombuffer(links, np.int32).reshape(len(own), -1)
                    place = np.full(len(x) + 1, -1, np.int64)
                    place[own] = np.arange(len(own))
                    entry = np.zeros((len(q), 1), np.int64) if found is None else place[found]
                    local = _walk(q, x[own], links, entry, BEAM)
                    found = np.where(local >= 0, own[local], -1)
                out = []
                for i, name in enumerate(names):
                    near = found[i][found[i] >= 0]
                    d = np.sqrt(((x[near].astype(np.float64) - q[i].astype(np.float64)) ** 2).sum(1))
                    hits = sorted((s, v) for s, j in zip(d, near) for v in r.ids[j] if v != name)[:k]
                    out += [(name, v, s) for s, v in hits]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    return run


def _block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"dim": [key[0]], "query_ids": [rows["vec_id"].to_numpy(np.int64).tobytes()],
                         "query_vectors": [np.stack(rows["v"].to_numpy()).astype(np.float32).tobytes()]})


def build_index(rows: DataFrame, k: int) -> DataFrame:
    """One row per shard: vectors, the ids each stands for, and the graph's flat neighbour arrays."""
    same = W.partitionBy("v").orderBy("vec_id")
    grouped = (rows.withColumn("rn", F.row_number().over(same)).where(F.col("rn") <= k + 1)
               .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    grouped = stored(grouped.withColumn("h", F.xxhash64("v")).withColumn("dim", F.size("v")), "vectors")
    shards = grouped.count() // SHARD + 1
    return stored(grouped.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInPandas(_build, INDEX), "graphs")


def nearest(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other vectors found for every row that ``queries`` selects."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).dropDuplicates(["vec_id", "v"])
    index = build_index(rows, k)
    asked = stored(rows.where(queries).withColumn("dim", F.size("v")), "queries")
    blocks = asked.count() // QUERIES + 1
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("dim", "block").applyInPandas(
        _block, "dim int, query_ids binary, query_vectors binary")
    tasks = index.join(asked, "dim").repartition(max(1, index.count() * blocks))
    found = tasks.mapInPandas(_search(k), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
