"""Exact inner-product search over norm-sorted blocks, rotated by the SVD of the vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.llm.common import discard, durable

K, QUERY_EVERY, SCALE = 5, 50, 256.0
#: Vectors of a candidate block (fewer if they are long: BLOCK_BYTES) and of a query block, leading rotated dimensions of
#: the partial sums, query blocks that meet a block in one task, and growth of the number of blocks tried in a round.
BLOCK, BLOCK_BYTES, QUERY_BLOCK, LEAD, TOGETHER, GROWTH = 8192, 16 << 20, 512, 16, 64, 8
#: Components beyond this magnitude leave the range in which float64 sums of products are exact; such rows use whole numbers.
EXACT = float(1 << 21)
LONG = (1 << 63) - 1


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, dims, v (float64 bytes of floor(256 x)), norm; vectors null or with a null or non-finite component are left
    out, and so are rows without vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).cast(pa.int64()), batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(lists.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(flat * SCALE)
            ends = np.cumsum(sizes)
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good = (wrong[ends] == wrong[ends - sizes]) & ids.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
            norms = np.zeros(len(sizes))
            full = sizes > 0
            if full.any():
                with np.errstate(over="ignore", invalid="ignore"):
                    norms[full] = np.sqrt(np.add.reduceat(flat * flat, (ends - sizes)[full]))
            cuts = (8 * np.concatenate([[0], ends])).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(flat))])
            out = pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int32)), data, pa.array(norms)], ["vec_id", "dims", "v", "norm"])
            yield out.filter(pa.array(good))

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, dims int, v binary, norm double")


def stacked(data: list[bytes], dims: int) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros."""
    if all(len(x) == 8 * dims for x in data):
        return np.frombuffer(b"".join(data)).reshape(len(data), dims).copy()
    out = np.zeros((len(data), dims))
    for i, x in enumerate(data):
        row = np.frombuffer(x)
        out[i, : len(row)] = row
    return out


def shrunk(x: np.ndarray) -> bytes:
    """As 32-bit floats if these hold every component exactly."""
    small = x.astype(np.float32)
    return (small if (small == x).all() else x).tobytes()


def grown(data: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if len(data) == 4 * rows * dims else np.float64).reshape(rows, dims).astype(np.float64)


def rotation(rows: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of all rows, from their Gram matrix: a sum of dims x dims numbers, added up on the executors."""

    def gram(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for f in frames:
            for at in range(0, len(f), 4096):
                x = stacked(f["v"].iloc[at : at + 4096].tolist(), dims)
                x /= max(1.0, np.abs(x).max(initial=0.0))
                total += x.T @ x
        yield pd.DataFrame({"place": np.arange(dims * dims), "value": total.ravel()})

    sums = rows.select("v").mapInPandas(gram, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    matrix = np.zeros(dims * dims)
    for r in sums:
        matrix[r["place"]] = r["value"]
    _, vectors = np.linalg.eigh(matrix.reshape(dims, dims))
    return np.ascontiguousarray(vectors[:, ::-1])


BLOCKS = "block long, top double, ids binary, data binary, norms binary"


def packed(rows: DataFrame, dims: int, size: int) -> DataFrame:
    """Blocks of `size` vectors in descending length: dealt by ranges of the norm, so blocks of one task are neighbours."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, None

        def block(f: pd.DataFrame) -> pd.DataFrame:
            x = stacked(f["v"].tolist(), dims)
            norms = f["norm"].to_numpy(np.float64)
            return pd.DataFrame({"block": [(part << 32) + number], "top": [norms.max()], "ids": [f["vec_id"].to_numpy(np.int64).tobytes()], "data": [shrunk(x)], "norms": [norms.tobytes()]})

        for f in frames:
            held = f if held is None else pd.concat([held, f])
            while len(held) >= size:
                yield block(held.iloc[:size])
                held, number = held.iloc[size:], number + 1
        if held is not None and len(held):
            yield block(held)

    # salted by the id, so that vectors of one length need not fall into one range
    order = [F.desc("norm"), F.asc("vec_id")]
    return rows.select("vec_id", "v", "norm").repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, BLOCKS)


def search_block(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, xnorm: np.ndarray, floor: np.ndarray, turn: np.ndarray, k: int, lead: int) -> list[tuple[int, int, int, int]]:
    """(place of the query, its id, vector, score) of each query's best in one block, of those at or above its floor.

    A query skips the vectors whose length times its own is below its floor; of the others it sums the leading rotated
    dimensions, adds the Cauchy-Schwarz bound of what the rest can give, and computes whole products only for survivors.
    Rounding gets a slack relative to the lengths, so no vector at the floor is lost.
    """
    exact = max(np.abs(q).max(initial=0.0), np.abs(x).max(initial=0.0)) <= EXACT
    qr, xr = q @ turn, x @ turn
    qn = np.sqrt((q * q).sum(1))
    q_rest, x_rest = np.sqrt((qr[:, lead:] ** 2).sum(1)), np.sqrt((xr[:, lead:] ** 2).sum(1))
    out = []
    for i in range(len(q)):
        slack = 1e-9 * (qn[i] * xnorm[0] + 1)
        n = int(np.searchsorted(-xnorm * qn[i], slack - floor[i], side="right")) if np.isfinite(floor[i]) else len(x)
        if not n:
            continue
        bound = xr[:n, :lead] @ qr[i, :lead] + q_rest[i] * x_rest[:n]
        left = np.flatnonzero((bound + slack >= floor[i]) & (xid[:n] != qid[i]))
        if not len(left):
            continue
        if exact:
            scores = (x[left] @ q[i]).astype(np.int64)
        else:
            whole = [int(v) for v in q[i]]
            scores = np.array([max(-LONG - 1, min(LONG, sum(int(a) * b for a, b in zip(x[j], whole, strict=True)))) for j in left], np.int64)
        order = np.lexsort((xid[left], -scores.astype(np.float64) if exact else -scores))[:k]
        out += [(i, int(qid[i]), int(xid[left[j]]), int(scores[j])) for j in order]
    return out


def least_length(data: bytes, ids: bytes, floors: bytes | None, dims: int) -> float:
    """Vectors shorter than this can't reach the floor of any query of a block."""
    n = len(ids) // 8
    if floors is None:
        return -np.inf
    q, floor = grown(data, n, dims), np.frombuffer(floors)
    length = np.sqrt((q * q).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        each = np.where(length > 0, (floor - 1e-9 * (np.abs(floor) + 1)) / length, -np.inf)
    return float(each.min())


FOUND = "qblock long, place int, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, lead: int = LEAD) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query (vec_id divisible by `every`).

    Ties go to the smaller vec_id; a query is never its own candidate, nor are rows that repeat its vec_id. Rows that
    repeat vec_id and vector are one query; rows that repeat only the vec_id are queries of their own, with k ranks each.
    Vectors shorter than the longest count as ending in zeros; a repeated vec_id is a candidate once for each row. Scores
    beyond the range of long are clamped to it.

    Blocks are tried by descending length, in rounds of 1, then GROWTH times as many. After each round a query's floor is
    its k-th score so far, and a block of queries meets only the blocks whose longest vector can reach one of its floors.
    One length a block of BLOCK vectors goes to the driver.
    """
    spark = vectors.sparkSession
    rows = durable(scaled(vectors), "vectors")
    dims = rows.agg(F.max("dims")).first()[0] or 1
    turn = rotation(rows, dims)
    blocks = durable(packed(rows, dims, max(1, min(BLOCK, BLOCK_BYTES // (8 * dims)))), "blocks")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "v"])
    queries = durable(packed(asked, dims, QUERY_BLOCK).select(F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("data").alias("qdata")), "query-blocks")
    tops = sorted((r["block"], r["top"]) for r in blocks.select("block", "top").collect())  # a number each block of vectors
    salts = -(-max(1, queries.count()) // TOGETHER)
    payload = blocks.select("block", "ids", "data", "norms")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                qid, xid = np.frombuffer(r.qids, np.int64), np.frombuffer(r.ids, np.int64)
                floor = np.frombuffer(r.floors) if r.floors is not None else np.full(len(qid), -np.inf)
                q, x = grown(r.qdata, len(qid), dims), grown(r.data, len(xid), dims)
                found = search_block(q, qid, x, xid, np.frombuffer(r.norms), floor, turn, k, min(lead, dims))
                out = pd.DataFrame(found, columns=["place", "query_id", "vec_id", "score"]).astype(np.int64)
                yield out.assign(qblock=np.full(len(out), r.qblock, np.int64), place=out["place"].astype(np.int32))[["qblock", "place", "query_id", "vec_id", "score"]]

    def with_floors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for ids, known in zip(f["qids"], f["lows"], strict=True):
                floor = np.full(len(ids) // 8, -np.inf)
                for r in known:
                    floor[r["place"]] = r["low"]
                out.append(floor.tobytes())
            yield f[["qblock", "qids", "qdata"]].assign(floors=out)

    best, start, width = None, 0, 1
    ready = queries.withColumn("floors", F.lit(None).cast("binary"))
    while start < len(tops):
        some = spark.sparkContext.broadcast(tops[start : start + width])

        def dealt(frames: Iterator[pd.DataFrame], some=some) -> Iterator[pd.DataFrame]:
            numbers, top = np.array([b for b, _ in some.value], np.int64), np.array([t for _, t in some.value])
            for f in frames:
                for r in f.itertuples():
                    met = numbers[top >= least_length(r.qdata, r.qids, r.floors, dims)]
                    yield pd.DataFrame({"qblock": np.full(len(met), r.qblock, np.int64), "block": met})

        # a block goes to one task for TOGETHER blocks of queries: no task gathers all queries of a block
        salt = F.pmod(F.xxhash64("qblock"), F.lit(salts)).cast("int")
        pairs = durable(ready.select("qblock", "qids", "qdata", "floors").mapInPandas(dealt, "qblock long, block long").withColumn("salt", salt), "block-pairs")
        sides = pairs.select("block", "salt").distinct().join(payload, "block")
        found = pairs.join(ready, "qblock").join(sides, ["block", "salt"]).mapInPandas(compare, FOUND)
        first = Window.partitionBy("qblock", "place").orderBy(F.desc("score"), F.asc("vec_id"))
        found = found if best is None else found.unionByName(best.drop("rank"))
        before, best = best, durable(found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k), "best")
        discard(before)
        discard(pairs)
        start, width = start + width, width * GROWTH
        if start < len(tops):
            lows = best.where(F.col("rank") == k).groupBy("qblock").agg(F.collect_list(F.struct("place", F.col("score").alias("low"))).alias("lows"))  # QUERY_BLOCK at most
            after = queries.join(lows, "qblock", "left").withColumn("lows", F.coalesce("lows", F.array().cast("array<struct<place:int,low:bigint>>")))
            ready = durable(after.mapInPandas(with_floors, "qblock long, qids binary, qdata binary, floors binary"), "ready")
    for x in (rows, blocks, queries):
        discard(x)
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
q AS (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 50 = 0),
s AS (SELECT a.vec_id AS query_id, a.x AS qx, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.x, b.x), lambda t: t[1] * t[2])) AS score
  FROM q a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, qx ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE k <= 5
"""
