"""Searches of a stated query set against all vectors, in blocks.

Vectors are packed into shards, queries into blocks; blocks are broadcast to the shards, some
at a time, each shard makes a top list for each query, and the lists are merged in a tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, written

#: Rows of a shard and of a block of queries; blocks of at most this many bytes together, or one
#: block, are broadcast to where the shards are.
SHARD_ROWS, BLOCK_ROWS, BROADCAST_BYTES = 4096, 4096, 32 << 20
#: Lists that one step of the merge tree puts together.
FAN_IN = 32


def usable(vectors: DataFrame, also: Callable[[Column], Column] = lambda _: F.lit(True)) -> DataFrame:
    """vec_id long and vector array<double> of the rows that take part: no null id, no null
    or empty vector, no null or non-finite component. Of rows with one vec_id, the least
    vector takes part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.where(F.col("vec_id").isNotNull() & fine & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    rows = rows.where(also(F.col("vector")))
    least = lambda df: df.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    again = written(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"))
    n = again.count()  # vectors themselves are shuffled only where ids repeat
    if not n:
        return rows
    if n > BROADCAST_KEYS:
        return least(rows)
    again = F.broadcast(again)
    return rows.join(again, "vec_id", "left_anti").unionByName(least(rows.join(again, "vec_id", "left_semi")))


def _packed(rows: DataFrame, part: str, build: Callable[[np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """A row for each (dim, part): ids in ascending order and what `build` makes of them."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_numpy()
        order = np.argsort(ids)
        flat = t.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        return pa.table({"dim": t.column("dim")[:1], part: t.column(part)[:1], "ids": [ids[order].tobytes()], "data": pa.array([build(ids[order], flat[order])], pa.binary())})

    return rows.groupBy("dim", part).applyInArrow(run, f"dim int, {part} int, ids binary, data binary")


def matrix(_: np.ndarray, rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows, np.float64).tobytes()


def best_lists(vectors: DataFrame, is_query: Column, k: int, build: Callable, search: Callable, kind: str) -> DataFrame:
    """(query_id, best): an ascending array of at most k structs (order, vec_id, score).

    build(ids, rows) makes a shard's bytes; search(bytes, ids, dim, query ids, queries)
    yields for each query the ids and scores of its best rows there. `kind`: type of scores.
    Only vectors of one length are compared.
    """
    rows = written(vectors.withColumn("dim", F.size("vector")))
    spread = F.xxhash64("vec_id")
    n, q = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-q // BLOCK_ROWS))
    index = _packed(rows.withColumn("shard", F.pmod(spread, F.lit(shards)).cast("int")), "shard", build)
    index = index.repartition(min(shards, max(2000, shards // 16)), "dim", "shard")
    ask = _packed(rows.where(is_query).withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int")), "block", matrix)
    ask = ask.select("dim", "block", F.col("ids").alias("qids"), F.col("data").alias("queries"))
    widest = rows.agg(F.max("dim")).first()[0] or 1
    at_once = max(1, BROADCAST_BYTES // (BLOCK_ROWS * widest * 8))  # blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.struct([("id", pa.int64()), ("score", pa.float64() if kind == "double" else pa.int64())])
        for b in batches:
            for r in range(b.num_rows):
                shard, dim, ids, data, qids, queries = (c[r].as_py() for c in b.columns)
                qids = np.frombuffer(qids, np.int64)
                found = list(search(data, np.frombuffer(ids, np.int64), dim, qids, np.frombuffer(queries, np.float64).reshape(-1, dim)))
                lists = [[{"id": int(i), "score": s.item()} for i, s in zip(*x)] for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(qids), pa.array([shard] * len(qids), pa.int32()), pa.array(lists, pa.list_(made))], names=["query_id", "part", "found"])

    def searched(asked: DataFrame) -> DataFrame:
        pairs = index.join(F.broadcast(asked), "dim").select("shard", "dim", "ids", "data", "qids", "queries")
        lists = pairs.mapInArrow(run, f"query_id long, part int, found array<struct<id long, score {kind}>>")
        best = lists.select("query_id", "part", F.transform("found", lambda x: F.struct((-x["score"]).alias("order"), x["id"].alias("vec_id"), x["score"].alias("score"))).alias("best"))
        parts = shards
        while True:
            parts = -(-parts // FAN_IN)
            best = best.groupBy("query_id", F.floor(F.col("part") / FAN_IN).cast("int").alias("part")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
            if parts == 1:
                return best.select("query_id", "best")

    if blocks <= at_once:
        return searched(ask)
    # shards stay where they were written, and blocks come to them, some in each round
    index, ask = written(index), written(ask)
    return reduce(DataFrame.union, [written(searched(ask.where(F.col("block").between(b, b + at_once - 1)))) for b in range(0, blocks, at_once)])


def ranked(best: DataFrame) -> DataFrame:
    out = best.select("query_id", F.posexplode("best").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def top(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of a query's scores over rows in the order of their ids, ties to the
    smaller id, without the query itself."""
    if (at := np.searchsorted(ids, own)) < len(ids) and ids[at] == own:
        scores, ids = np.delete(scores, at), np.delete(ids, at)
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        over = np.flatnonzero(scores > least)
        keep = np.sort(np.concatenate((over, np.flatnonzero(scores == least)[: k - len(over)])))
        scores, ids = scores[keep], ids[keep]
    order = np.argsort(-scores, kind="stable")
    return ids[order], scores[order]


def inner_products(data: bytes, ids: np.ndarray, dim: int, qids: np.ndarray, queries: np.ndarray, k: int, scale: float, tile: int = 512):
    """Tiles of queries times the shard's matrix. Products of integers are exact in double
    precision while their sums stay under 2**53; beyond, Python's integers are used, and
    scores outside 64 bits are held at its limits."""
    rows = np.floor(np.frombuffer(data, np.float64).reshape(-1, dim) * scale)
    queries = np.floor(queries * scale)
    exact = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * dim < 2.0**53
    if not exact:
        whole = np.array([[int(x) for x in r] for r in rows.tolist()], object)
    for a in range(0, len(queries), tile):
        if exact:
            scores = (queries[a : a + tile] @ rows.T).astype(np.int64)
        else:
            asked = np.array([[int(x) for x in r] for r in queries[a : a + tile].tolist()], object)
            scores = np.clip(asked.dot(whole.T), -(2**63) + 1, 2**63 - 1).astype(np.int64)
        for q, s in zip(qids[a : a + tile], scores):
            yield top(s, ids, q, k)


def exact_topk(vectors: DataFrame, every: int = 100, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """The k rows of largest integer inner product for each row whose vec_id is divisible by
    `every`, ties to the smaller vec_id; components are floor(scale * x).

    Queries in tiles are multiplied with shards of vectors, each tile keeps the top of each
    query by partial selection, and the lists of the shards are merged in a tree of fan-in
    FAN_IN. A query gets all other rows if they are fewer than k; a query alone has no rows.

    vectors: vec_id, embedding; other columns are ignored. See usable() for nulls, odd
    values and repeated ids. No rows give no rows.

    Returns query_id long, rank int, vec_id long, score long.
    """

    def search(data, ids, dim, qids, queries):
        return inner_products(data, ids, dim, qids, queries, k, scale)

    return ranked(best_lists(usable(vectors), F.col("vec_id") % every == 0, k, matrix, search, "long"))
