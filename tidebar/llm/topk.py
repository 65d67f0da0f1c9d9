"""Exact top-k inner products by KD-trees, one per shard.

Vectors are dealt into shards and each shard builds a KD-tree: median splits of the widest dimension and tight bounding
boxes. A query walks a tree best first: a box's largest possible product bounds what it holds, and the walk ends when
no bound reaches the k-th score so far. A first shard gives each block of queries that score, which is then passed on
to all other shards.

Components are whole numbers held as doubles. Products of doubles are exact while their sizes sum to less than 2**53;
boxes in which they do not have their bounds raised by what rounding can take, and rows near the k-th score are told
apart by Python's integers.
"""

from __future__ import annotations

import heapq
import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.store import partitions_for, written

#: Sums of products below it are exact as doubles.
_EXACT = 2.0**53
#: What a score column holds.
_LONG = (-(2**63), 2**63 - 1)
#: Vectors of a shard, queries of a block, and vectors of a leaf, at most about.
SHARD, BLOCK, LEAF = 32_768, 512, 128


def integer_vector(column: Column) -> Column:
    """floor(256 * x) of each component, as a whole double; null unless all components are finite numbers. Beyond the doubles the greatest one stands."""
    wrong = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    most = F.lit(sys.float_info.max)
    scaled = lambda x: F.greatest(-most, F.least(most, x.cast("double") * 256.0))
    return F.when(~wrong, F.transform(F.transform(column, scaled), lambda y: F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)))


_whole = np.frompyfunc(int, 1, 1)


def _below(score: int) -> float:
    """The greatest double that is surely not above score."""
    if abs(score) <= _EXACT:
        return float(score)
    try:
        return float(np.nextafter(float(score), -np.inf))
    except OverflowError:
        return sys.float_info.max if score > 0 else -np.inf


class Tree:
    """A KD-tree over the rows of a matrix of whole numbers; parts of a node are the rows from begin to end."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        order, self.begin, self.end, self.child, k = np.arange(len(ids)), [0], [len(ids)], [-1], 0
        while k < len(self.begin):
            a, b = self.begin[k], self.end[k]
            part = x[order[a:b]]
            spread = part.max(axis=0) - part.min(axis=0) if b > a and x.shape[1] else np.zeros(1)
            if b - a > LEAF and spread.max() > 0:
                d, mid = int(spread.argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, d], mid)]
                self.child[k] = len(self.begin)
                self.begin += [a, a + mid]
                self.end += [a + mid, b]
                self.child += [-1, -1]
            k += 1
        self.ids, self.x = ids[order], x[order]
        self.lo = np.array([self.x[a:b].min(axis=0) for a, b in zip(self.begin, self.end, strict=True)])
        self.hi = np.array([self.x[a:b].max(axis=0) for a, b in zip(self.begin, self.end, strict=True)])
        self.least = np.array([self.ids[a:b].min() for a, b in zip(self.begin, self.end, strict=True)])

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, best: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
        """For each query the k best (score, -id) among best and this tree's rows, its own row left out; best first."""
        width = max(q.shape[1], self.x.shape[1])
        pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        q, lo, hi, x = pad(q), pad(self.lo), pad(self.hi), pad(self.x)
        with np.errstate(over="ignore", invalid="ignore"):
            mass = np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi)).T
            slack = np.where(mass < _EXACT, 0.0, np.where(np.isfinite(mass), mass * (width + 4) * 2.0**-51, np.inf))
            bounds = np.where(slack == np.inf, np.inf, np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T + slack)
        out = []
        for i, own in enumerate(query_ids):
            heap = list(best[i])  # smallest first
            heapq.heapify(heap)
            bound_of = bounds[i].tolist()  # Python compares its floats with integers of any size exactly
            walk = [(-bound_of[0], 0)]
            while walk:
                bound, node = heapq.heappop(walk)
                if len(heap) == k and (-bound, -self.least[node]) < heap[0]:
                    if -bound < heap[0][0]:
                        break
                    continue
                if (c := self.child[node]) >= 0:
                    for c in (c, c + 1):
                        if len(heap) < k or bound_of[c] >= heap[0][0]:
                            heapq.heappush(walk, (-bound_of[c], c))
                    continue
                a, b = self.begin[node], self.end[node]
                with np.errstate(over="ignore", invalid="ignore"):
                    score = x[a:b] @ q[i]
                    near = ~(score + slack[i, node] < _below(heap[0][0])) if len(heap) == k else np.ones(b - a, dtype=bool)
                rows = np.flatnonzero(near & (self.ids[a:b] != own))
                if slack[i, node]:
                    sums = _whole(x[a:b][rows]) @ _whole(q[i]) if len(rows) else []
                else:
                    if len(rows) > k:
                        rows = rows[np.lexsort((self.ids[a:b][rows], -score[rows]))[:k]]
                    sums = score[rows]
                for r, s in zip(rows, sums, strict=True):
                    entry = (int(s), -int(self.ids[a + r]))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
            out.append(sorted(heap, reverse=True))
        return out


def _matrix(lists: pa.Array) -> np.ndarray:
    rows = lists.to_numpy(zero_copy_only=False)
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _gather(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most size rows each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            take = min(batch.num_rows, size - sum(b.num_rows for b in held))
            held.append(batch.slice(0, take))
            batch = batch.slice(take)
            if sum(b.num_rows for b in held) == size:
                t = pa.Table.from_batches(held).combine_chunks()
                yield t.column(0).to_numpy(), _matrix(t.column(1).combine_chunks())
                held = []
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t.column(0).to_numpy(), _matrix(t.column(1).combine_chunks())


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, x in _gather(batches, SHARD):
        if len(np.unique(ids)) < len(ids):  # a repeated row is one candidate
            same = np.unique(x, axis=0, return_inverse=True)[1].reshape(-1)
            keep = np.unique(np.column_stack([ids, same]), axis=0, return_index=True)[1]
            ids, x = ids[keep], x[keep]
        yield pa.RecordBatch.from_pydict({"tree": pa.array([pickle.dumps(Tree(ids, x))], type=pa.binary())})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, x in _gather(batches, BLOCK):
        yield pa.RecordBatch.from_pydict({"queries": pa.array([pickle.dumps((ids, x))], type=pa.binary())})


def _searcher(k: int):
    """Rows come by shard, each shard's tree before the blocks of queries that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = tree = None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("tree")[i].is_valid:
                    stored, tree = batch.column("tree")[i].as_py(), None
                    continue
                if tree is None:
                    stored, tree = None, pickle.loads(stored)
                ids, x = pickle.loads(batch.column("queries")[i].as_py())
                known = batch.column("best")[i].as_py()
                best = pickle.loads(known) if known else [[] for _ in ids]
                yield pa.RecordBatch.from_pydict({"block": pa.array([batch.column("block")[i].as_py()], type=pa.int64()), "best": pa.array([pickle.dumps(tree.search(ids, x, k, best))], type=pa.binary())})

    return run


def _beyond(score: int) -> bytes:
    """Bytes that order scores at and beyond the ends of a long as the scores are; none inside."""
    if _LONG[0] < score < _LONG[1]:
        return b""
    size = (abs(score).bit_length() + 7) // 8
    key = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return key if score > 0 else bytes(255 - b for b in key)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, _ = pickle.loads(batch.column("queries")[i].as_py())
            rows = [(int(q), -e, s) for q, best in zip(ids, pickle.loads(batch.column("best")[i].as_py()), strict=True) for s, e in best]
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array([r[0] for r in rows], type=pa.int64()), "vec_id": pa.array([r[1] for r in rows], type=pa.int64()),
                "score": pa.array([min(max(r[2], _LONG[0]), _LONG[1]) for r in rows], type=pa.int64()), "beyond": pa.array([_beyond(r[2]) for r in rows], type=pa.binary()),
            })


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that the condition queries marks, its k best other rows: query_id, rank, vec_id, score.

    Score: inner product of the vectors as integers, floor(256 * x), exact at any size (ranks too; a score that no long holds
    is given as the nearest long); ties go to the smaller id. Rows whose vector is
    null, or holds null or non-finite components, and rows with a null id take no part; shorter vectors count as padded
    with zeros. Rows that share an id are not each other's candidates. With fewer than k candidates all are returned;
    empty tables give no rows. Further columns are not looked at. Blocks of queries meet shards; equal vectors, however
    many, spread over all shards by id.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integer_vector(F.col(vector_col)).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where("id is not null and v is not null")
    rows = written(rows, "vectors")
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    shards = partitions_for(spark, n, SHARD)
    number = F.monotonically_increasing_id()
    trees = written(rows.select("id", "v").repartition(shards, "id").mapInArrow(_build, "tree binary").withColumn("shard", number), "trees")
    asks = rows.where("asks").select("id", "v")
    asks = asks.repartition(max(1, -(-asked // BLOCK)), "id") if asked else asks
    blocks = written(asks.mapInArrow(_blocks, "queries binary").withColumn("block", number), "blocks")
    # numbers of shards and blocks, in order: one narrow row for each of them
    index = trees.select("shard").withColumn("at", F.row_number().over(Window.orderBy("shard")) - 1)
    count = trees.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index = written(index, "shard-numbers")
    turn = F.pmod(F.xxhash64("block"), F.lit(count))
    bare = lambda kind: F.lit(None).cast(kind)
    held = trees.select("shard", F.lit(0).alias("kind"), "tree", bare("long").alias("block"), bare("binary").alias("queries"), bare("binary").alias("best"))

    def meet(pairs: DataFrame) -> DataFrame:
        """Searches of blocks in shards; each tree is sent once, before its blocks."""
        asked = pairs.select("shard", F.lit(1).alias("kind"), bare("binary").alias("tree"), "block", "queries", "best")
        return held.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind").drop("shard", "kind").mapInArrow(_searcher(k), "block long, best binary")

    first = written(meet(blocks.withColumn("at", turn).join(index, "at").withColumn("best", bare("binary"))), "first-shard")
    rest = blocks.join(first, "block").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).where(F.col("at") != turn)
    rest = written(meet(rest.join(index, "at")), "other-shards")
    found = first.unionByName(rest).join(blocks, "block").select("queries", "best").mapInArrow(_unpack, "query_id long, vec_id long, score long, beyond binary").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
