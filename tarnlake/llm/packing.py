"""Harmonic packing: lengths fall into reciprocal-capacity classes, each filled with a fixed count of pieces."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.llm.common import buckets_for, durable, global_rank, tidy

CAPACITY, END_ID, CUTS = 2048, 1, 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int"


def class_counts(capacity: int) -> list[int]:
    """Pieces per sequence of each class: 1 to 32, then steps of about a quarter up to the capacity."""
    out, k = [], 1
    while k <= capacity:
        out.append(k)
        k = k + 1 if k < 32 else k + max(1, k // 4)
    return out if out[-1] == capacity else [*out, capacity]


def class_of(length: int, counts: list[int], capacity: int) -> int:
    """The most pieces of this length that a sequence surely holds, rounded down to a class."""
    return max(k for k in counts if k * length <= capacity)


def cut_lengths(n: int, capacity: int, cuts: int = CUTS, least: int = 64) -> list[int]:
    """Full sequences first; the rest loses up to `cuts` pieces that fill their class exactly, and ends in one last piece."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest and cuts:
        part = capacity // -(-capacity // rest)
        if rest < least or part == rest or rest - part < 1:
            break
        out.append(part)
        rest -= part
        cuts -= 1
    return [*out, rest] if rest else out


def piece_rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    from tarnlake.llm.tokens import encoder, groups

    encode, counts = encoder(path).encode_many, class_counts(capacity)
    end = np.array([end_id], "<u4").tobytes()
    kind = [0, *[class_of(n, counts, capacity) for n in range(1, capacity + 1)]]
    for docs, texts in groups(batches):
        rows: list[tuple] = []
        for doc, ids in zip(docs, encode(texts), strict=True):
            ids = memoryview(bytes(ids) + end)
            n, at = len(ids) // 4, 0
            for length in cut_lengths(n, capacity):
                rows.append((doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, kind[length]))
                at += length
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = [pa.int64()] * 5 + [pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k"])


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents (null text: only the end id) and their places in sequences of at most `capacity` ids.

    A sequence of class k takes exactly k pieces of at most capacity/k ids. Pieces are numbered within their class from
    counts per bucket of documents, so every worker fills whole sequences on its own; no class meets in one task. What is
    left over in each class, fewer than k pieces, is bounded by the sum of all k however large the corpus is; those
    pieces are placed first-fit by descending length. Equal or null doc_id values are kept as rows of their own.
    """
    spark = docs.sparkSession
    pieces = durable(docs.select("doc_id", "text").mapInArrow(tidy(lambda b: piece_rows(b, tokenizer_path, end_id, capacity)), PIECES), "pieces")
    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets_for(spark, pieces.count())))
    order: list[Column] = [F.col(c) for c in ("doc_id", "start", "ids_crc32", "doc_tokens")]
    ranked = durable(global_rank(pieces.withColumn("b", bucket), "b", order, "rank", ("k",)).drop("b"), "ranked")
    totals = ranked.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per class, at most len(class_counts)
    base, starts = 0, {}
    for k, n in sorted((r["k"], r["n"]) for r in totals):
        starts[k] = (base, n // k)
        base += n // k
    known = spark.createDataFrame([(k, *v) for k, v in starts.items()] or [(0, 0, 0)], "kk int, base long, full long")
    placed = ranked.join(F.broadcast(known), F.col("k") == F.col("kk")).withColumn("bin", F.floor(F.col("rank") / F.col("k")))
    whole = placed.where("bin < full").withColumn("sequence_id", F.col("base") + F.col("bin"))
    in_bin = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)))
    left = placed.where("bin >= full").select("k", "rank", "length").collect()  # fewer than the sum of all k
    spots = first_fit([(r["length"], r["k"], r["rank"]) for r in left], capacity, base)
    spots_df = spark.createDataFrame(spots or [(0, -1, 0, 0)], "lk int, lrank long, sequence_id long, offset long")
    rest = placed.where("bin >= full").join(F.broadcast(spots_df), (F.col("k") == F.col("lk")) & (F.col("rank") == F.col("lrank")))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return whole.select(*columns).unionByName(rest.select(*columns))


def first_fit(pieces: list[tuple[int, int, int]], capacity: int, base: int) -> list[tuple[int, int, int, int]]:
    """(length, k, rank) -> (k, rank, sequence_id, offset), longest first, each into the first sequence with room."""
    used: list[int] = []
    out = []
    for length, k, rank in sorted(pieces, reverse=True):
        spot = next((i for i, u in enumerate(used) if u + length <= capacity), len(used))
        if spot == len(used):
            used.append(0)
        out.append((k, rank, base + spot, used[spot]))
        used[spot] += length
    return out
