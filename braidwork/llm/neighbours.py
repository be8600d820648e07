"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidwork.llm.common import Shared, store, sampled

TREES, DEPTH = 4, 8
#: Distinct vectors that the trees are fitted on (expected number; chosen by hash). Every vector is indexed.
SAMPLE = 20_000
#: Leaves of all trees that a query visits, as a part of all leaves.
VISITS = 0.35
#: Random directions of which a node takes the one that spreads its vectors most.
DIRECTIONS = 12
#: Vectors of one leaf that one task compares at a time; larger leaves are salted.
LEAF_BLOCK = 20_000


class Forest:
    """Balanced trees of hyperplanes: at each node a projection and a threshold, at the median of the node's sample."""

    def __init__(self, sample: np.ndarray, trees: int, seed: int):
        rng, self.size = np.random.default_rng(seed), sample.shape[1]
        self.depth = max(0, min(DEPTH, int(np.log2(max(len(sample), 1) / 32)))) if len(sample) >= 64 else 0
        inner = 2**self.depth - 1
        self.planes, self.cuts = np.zeros((trees, inner, self.size)), np.zeros((trees, inner))
        for t in range(trees if inner else 0):
            node = np.zeros(len(sample), dtype=np.int64)
            for k in range(inner):
                mine = np.flatnonzero(node == k)
                ways = rng.normal(size=(DIRECTIONS, self.size))
                ways /= np.linalg.norm(ways, axis=1, keepdims=True)
                at = sample[mine] @ ways.T
                best = int(at.std(axis=0).argmax()) if len(mine) else 0
                self.planes[t, k] = ways[best]
                self.cuts[t, k] = np.median(at[:, best]) if len(mine) else 0.0
                node[mine] = 2 * k + 1 + (at[:, best] > self.cuts[t, k])

    def margins(self, unit: np.ndarray) -> np.ndarray:
        """Signed distances of each vector to each plane: vectors x trees x nodes."""
        return np.einsum("nd,tkd->ntk", unit, self.planes, optimize=True) - self.cuts

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        margin, node = self.margins(unit), np.zeros((len(unit), len(self.planes)), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.take_along_axis(margin, node[:, :, None], axis=2)[:, :, 0] > 0)
        return node - (2**self.depth - 1)

    def search(self, unit: np.ndarray, visits: int):
        """For each vector the (tree, leaf) pairs nearest to it: one queue over all trees, by squared distance behind planes."""
        inner = 2**self.depth - 1
        for margin in self.margins(unit):
            found, queue = [], [(0.0, t, 0) for t in range(len(self.planes))]
            while queue and len(found) < visits:
                cost, t, k = heapq.heappop(queue)
                while k < inner:
                    m = margin[t, k]
                    near = 2 * k + 1 + (m > 0)
                    heapq.heappush(queue, (cost + m * m, t, 4 * k + 3 - near))
                    k = near
                found.append((t, k - inner))
            yield found


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    return raw, raw / np.linalg.norm(raw, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, vec) that take part: id and vector not null, not empty or zero, all components finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").where(~bad)
    rows = rows.where(F.exists("embedding", lambda x: x != 0))
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    return rows.select("vec_id", F.transform("embedding", lambda x: x + F.lit(0).cast(kind)).alias("vec"))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, trees: int = TREES, visits: float = VISITS, seed: int = 2) -> DataFrame:
    """The k nearest rows found for each query row: query_id, rank, vec_id, score.

    vectors: vec_id, embedding. Queries are the rows whose id `every` divides, candidates all rows with another
    id. Nearness is the cosine in double precision; ties go to the smaller id. Null ids, and vectors that are
    null, empty, zero or hold null or non-finite components, take no part; nor do vectors that haven't the most
    frequent number of components (the larger of equally frequent ones). Rows that repeat an id with the same
    vector count once. With fewer candidates than k all are returned; an empty table gives no row.

    The forest is fitted on about SAMPLE vectors and sent to the tasks; its size doesn't grow with the table.
    Equal vectors are one entry that carries the k + 1 smallest of their ids, which is all that an answer can
    name, so a hot vector is one candidate. Entries are keyed by tree and leaf; each query's leaves come from
    one priority queue over all trees; leaves are compared in salted blocks, exactly.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vec") == sizes["n"])
    # The ids of equal vectors, cut to the smallest in salted parts before they meet.
    salted = rows.select("vec", "vec_id").distinct().withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy("vec", "_salt").orderBy("vec_id"))).where(f"_r <= {k + 1}")
    entries = few.groupBy("vec").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    entries = store(entries.select(F.col("ids")[0].alias("entry"), "ids", "vec"), "neighbours-entries")
    count = entries.count()
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "vec").distinct()
    asked = store(queries.join(entries, "vec").select(F.col("vec_id").alias("query_id"), "entry"), "neighbours-queries")
    sample = sampled(entries, count, SAMPLE, seed, "entry").select("vec").toArrow()
    column = sample.column(0).combine_chunks()
    fitted = Forest(unit_rows(column)[1] if len(column) else np.zeros((0, sizes["n"])), trees, seed)
    shared = Shared(spark, fitted)
    leaves = trees * 2**fitted.depth
    most = max(trees, round(visits * leaves))
    salts = -(-count // (LEAF_BLOCK * 2**fitted.depth))

    def place(batches):
        forest = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                at = forest.leaves(unit_rows(part.column(2))[1])
                pick = pa.array(np.repeat(np.arange(part.num_rows), trees))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees), part.num_rows)), pa.array(at.ravel()), *(c.take(pick) for c in part.columns)], names=["tree", "leaf", "entry", "ids", "vec"])

    def visit(batches):
        forest = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                found = list(forest.search(unit_rows(part.column(1))[1], most))
                pick = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
                pairs = np.array([p for f in found for p in f], dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *(c.take(pick) for c in part.columns)], names=["tree", "leaf", "asker", "vec"])

    index = entries.mapInArrow(place, "tree long, leaf long, entry long, ids array<long>, vec array<double>" if dict(entries.dtypes)["vec"] == "array<double>" else "tree long, leaf long, entry long, ids array<long>, vec array<float>")
    index = index.withColumn("salt", F.pmod(F.xxhash64("entry"), F.lit(salts)))
    askers = asked.select("entry").distinct().join(entries.select("entry", "vec"), "entry").select(F.col("entry").alias("asker"), "vec")
    kind = dict(entries.dtypes)["vec"]
    asks = askers.mapInArrow(visit, f"tree long, leaf long, asker long, vec {kind}")
    asks = asks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"asker": [], "entry": [], "ids": [], "score": []}
        if left.num_rows and right.num_rows:
            raw, _ = unit_rows(left.column("vec").combine_chunks())
            entry = np.asarray(left.column("entry"))
            norm = np.sqrt((raw * raw).sum(axis=1))
            ids = left.column("ids").combine_chunks()
            asker = np.asarray(right.column("asker"))
            for low in range(0, len(asker), 256):
                q, _ = unit_rows(right.column("vec").slice(low, 256).combine_chunks())
                score = (q @ raw.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * norm)
                order = np.lexsort((np.broadcast_to(entry, score.shape), -score), axis=1)[:, : k + 1] if score.shape[1] > k + 1 else np.tile(np.arange(score.shape[1]), (len(q), 1))
                out["asker"].append(np.repeat(asker[low : low + 256], order.shape[1]))
                out["entry"].append(order.ravel())
                out["score"].append(np.take_along_axis(score, order, axis=1).ravel())
        if not out["asker"]:
            return pa.table({"asker": pa.array([], pa.int64()), "entry": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        pick = np.concatenate(out["entry"])
        return pa.table({"asker": np.concatenate(out["asker"]), "entry": entry[pick], "ids": ids.take(pa.array(pick)), "score": np.concatenate(out["score"])})

    keys = ["tree", "leaf", "salt"]
    compared = index.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(compare, "asker long, entry long, ids array<long>, score double")
    best = compared.groupBy("asker", "entry").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    by_score = Window.partitionBy("asker").orderBy(F.desc("score"), "entry")
    best = best.withColumn("_r", F.row_number().over(by_score)).where(f"_r <= {k + 1}").drop("_r")
    answers = asked.join(best, asked["entry"] == best["asker"]).select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id != vec_id")
    answers = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
