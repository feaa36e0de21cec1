"""Exact top-k inner products: a ball tree per shard, searched by branch and bound with a shared threshold."""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import cut

K, EVERY = 5, 50
#: Numbers in a shard's matrix, and queries of a block: what one task holds at a time.
SHARD_NUMBERS, QUERY_BLOCK = 1 << 20, 256
#: Blocks that a task searches one tree with.
CHUNK = 64
LEAF = 128
#: Sums of products below this are exact in doubles.
EXACT = 2.0 ** 52


def quantised(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as long; null for vectors that are null, empty or hold null or non-finite components."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(whole & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


class BallTree:
    """Nodes hold a range of rows, their centre and radius; rows are reordered so that a node's are adjacent."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.order = np.arange(len(ids))
        self.first, self.last, self.left, self.right, centres, radius = [], [], [], [], [], []
        points = vectors.astype(np.float64)
        todo = [(0, len(ids), -1, False)]
        while todo:
            a, b, parent, is_right = todo.pop()
            node, rows = len(self.first), points[self.order[a:b]]
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            centre = rows.mean(axis=0)
            away = np.linalg.norm(rows - centre, axis=1)
            self.first.append(a)
            self.last.append(b)
            self.left.append(-1)
            self.right.append(-1)
            centres.append(centre)
            radius.append(float(away.max()))
            if b - a > LEAF and radius[-1] > 0:
                # Cut at the median along the line between two far points.
                one = rows[int(away.argmax())]
                other = rows[int(np.linalg.norm(rows - one, axis=1).argmax())]
                along = rows @ (other - one)
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(along, middle)]
                todo += [(a, a + middle, node, False), (a + middle, b, node, True)]
        self.radius = np.array(radius)
        self.centres, self.ids, self.vectors = np.array(centres), ids[self.order], vectors[self.order]
        self.longest = float(np.linalg.norm(points, axis=1).max())

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> pd.DataFrame:
        """(pos, vec_id, score) of each query's k best rows, of those that reach its ``least``; ties to smaller ids.

        Nodes are visited by descending upper bound q.centre + |q| radius, for all queries that may
        still gain there; a query leaves a node whose bound is below its kth score so far. Equal
        bounds are not pruned, so ties are decided exactly. A query's own rows take no part.
        """
        q = queries.astype(np.float64)
        norms = np.linalg.norm(q, axis=1)
        exact = norms.max() * self.longest < EXACT
        bounds = q @ self.centres.T + norms[:, None] * self.radius[None]
        bounds += 1e-9 * norms[:, None] * (self.longest + 1) + 1e-6  # rounding of the bound itself
        kth = least.copy()
        nothing = np.zeros(0, np.int64)
        best = [(nothing, nothing)] * len(q)
        waiting = [(0.0, 0, np.arange(len(q)))]
        while waiting:
            _, node, who = heapq.heappop(waiting)
            who = who[bounds[who, node] >= kth[who]]
            if not len(who):
                continue
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(waiting, (-float(bounds[who, child].max()), child, who))
                continue
            a, b = self.first[node], self.last[node]
            if exact:
                scores = np.rint(q[who] @ self.vectors[a:b].T.astype(np.float64)).astype(np.int64)
            else:
                scores = queries[who].astype(np.int64) @ self.vectors[a:b].T.astype(np.int64)
            fits = (scores >= kth[who][:, None]) & (self.ids[a:b][None] != query_ids[who][:, None])
            for row in np.flatnonzero(fits.any(axis=1)):
                i, use = who[row], np.flatnonzero(fits[row])
                ids, found = np.append(best[i][0], self.ids[a:b][use]), np.append(best[i][1], scores[row, use])
                top = np.lexsort((ids, -found))[:k]
                best[i] = (ids[top], found[top])
                if len(top) == k:
                    kth[i] = max(kth[i], found[top[-1]])
        return pd.DataFrame({"pos": np.repeat(np.arange(len(q)), [len(x) for x, _ in best]),
                             "vec_id": np.concatenate([x for x, _ in best]), "score": np.concatenate([x for _, x in best])})


def _matrix(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    frame = frame.sort_values("vec_id", kind="stable")
    vectors = np.stack(frame["v"].to_numpy()).astype(np.int64)
    most = np.abs(vectors.astype(np.float64)).max()
    return frame["vec_id"].to_numpy(dtype=np.int64), vectors.astype(np.int16) if most < 32000 else vectors


def _tree(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.iloc[:1][["dim", "shard"]].assign(tree=[pickle.dumps(BallTree(*_matrix(frame)))])


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.iloc[:1][["dim", "block"]].assign(queries=[pickle.dumps(_matrix(frame))])


def _searched(k: int):
    def search(trees: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({n: np.zeros(0, np.int64) for n in ("dim", "block", "pos", "query_id", "vec_id", "score")})]
        if len(trees):
            tree = pickle.loads(trees["tree"].iloc[0])
            for row in blocks.itertuples(index=False):
                ids, vectors = pickle.loads(row.queries)
                least = np.full(len(ids), np.iinfo(np.int64).min)
                if row.least is not None:
                    least[np.array(row.least_pos, dtype=np.int64)] = np.array(row.least, dtype=np.int64)
                found = tree.search(ids, vectors, least, k)
                out.append(found.assign(dim=row.dim, block=row.block, query_id=ids[found["pos"]])[out[0].columns])
        return pd.concat(out, ignore_index=True)
    return search


def top_products(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = EVERY,
                 k: int = K, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by ``every``, its k highest integer inner products.

    Components become floor(scale * x). Candidates are all rows of the same length with another id;
    ties go to smaller ids, fewer than k candidates are all returned. Rows of null id, and vectors
    that are null, empty or hold null or non-finite components take no part. Repeated rows are
    candidates, and queries, each for itself. Scores are 64-bit and wrap beyond that.

    Rows are dealt into shards of bounded size, one ball tree each, and queries into blocks. A block
    first searches one shard; the kth score found there then prunes its search of all other shards.
    A task holds one tree and at most CHUNK blocks, whatever the table's size.
    """
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), quantised(vector_column, scale).alias("v"))
    rows = rows.where("vec_id is not null and v is not null").withColumn("dim", F.size("v").cast("bigint"))
    rows = cut(rows.withColumn("n", F.monotonically_increasing_id()))
    query = F.col("vec_id") % every == 0
    sizes = rows.groupBy("dim").agg(
        F.ceil(F.count("*") * F.col("dim") / SHARD_NUMBERS).alias("shards"),
        F.ceil(F.sum(query.cast("bigint")) / QUERY_BLOCK).alias("blocks"))
    rows = rows.join(F.broadcast(cut(sizes)), "dim")  # a row for each length of vector
    trees = cut(rows.withColumn("shard", F.pmod("n", "shards")).groupBy("dim", "shard").applyInPandas(
        _tree, "dim bigint, shard bigint, tree binary"))
    blocks = rows.where(query).withColumn("block", F.pmod(F.xxhash64("n"), "blocks")).groupBy("dim", "block").applyInPandas(
        _block, "dim bigint, block bigint, queries binary")
    blocks = cut(blocks.join(F.broadcast(sizes), "dim").withColumn("chunk", F.floor(F.col("block") / CHUNK)))
    none = [F.lit(None).cast("array<bigint>").alias(n) for n in ("least_pos", "least")]

    def searched(work: DataFrame) -> DataFrame:
        wanted = work.select(F.col("dim").alias("d"), F.col("shard").alias("s"), F.col("chunk").alias("c")).distinct()
        needed = trees.join(wanted, (F.col("dim") == F.col("d")) & (F.col("shard") == F.col("s")))
        return (needed.groupBy("d", "s", "c").cogroup(
            work.groupBy("dim", "shard", "chunk")).applyInPandas(
                _searched(k), "dim bigint, block bigint, pos bigint, query_id bigint, vec_id bigint, score bigint"))

    first = cut(searched(blocks.select("*", F.pmod("block", "shards").alias("shard"), *none)))
    kth = first.groupBy("dim", "block", "pos").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k)
    kth = kth.groupBy("dim", "block").agg(F.collect_list(F.struct("pos", "score")).alias("kth"))
    others = blocks.join(kth, ["dim", "block"], "left").select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)).alias("shard"),
        F.col("kth.pos").alias("least_pos"), F.col("kth.score").alias("least"))
    others = searched(others.where("shard <> pmod(block, shards)").drop("kth"))
    order = Window.partitionBy("dim", "block", "pos").orderBy(F.desc("score"), "vec_id")
    ranked = first.union(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
