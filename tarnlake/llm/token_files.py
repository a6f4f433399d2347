"""Token-ID output: Parquet list columns with delta encoding, ordered row groups and page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.llm.common import small_broadcast, tidy, workspace

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def encode_rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    from tarnlake.llm.tokens import encoder, groups

    encode, part, at = encoder(path).encode_many, TaskContext.get().partitionId(), 0
    end = np.array([end_id], "<u4").tobytes()

    def flush(docs: list, texts: list) -> pa.RecordBatch:
        ids = [bytes(x) + end for x in encode(texts)]
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        values = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        starts = at + np.concatenate([[0], np.cumsum(lengths)[:-1]])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        return pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(np.full(len(docs), part, np.int32)), pa.array(starts.astype(np.int64)), pa.array(lengths), lists],
            ["doc_id", "part", "part_start", "n_tokens", "ids"],
        )

    for docs, texts in groups(batches):
        out = flush(docs, texts)
        at += len(out.column(4).values)
        yield out


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, row_group_bytes: int = 16 << 20, page_rows: int = 2_000) -> None:
    """Encode every text (null: empty), append `end_id`, and write ids in ascending doc_id order.

    Texts are dealt to files by ranges of doc_id and encoded there, so ids are never shuffled. The ids column is delta
    encoded (format version 2, no dictionary); the small columns keep dictionaries and all have page indexes, so a reader
    that asks for some documents or for metadata only skips the other pages. Rows with equal or null doc_id are kept
    (null first); an empty table gives files without rows.
    """
    dealt = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id")
    rows = dealt.mapInArrow(tidy(lambda batches: encode_rows(batches, tokenizer_path, end_id)), SCHEMA)
    rows.write.options(**{
        "compression": "zstd",
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary#ids.list.element": "false",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.row.count.limit": str(page_rows),
    }).parquet(folder)


def part_offsets(files: DataFrame) -> DataFrame:
    """(at_part, before): ids in all files before each one; one row a file."""
    per_part = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return small_broadcast(per_part.select(F.col("part").alias("at_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))


def read_tokens(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of the files with `start`, the number of ids of all documents before; only `columns` are read."""
    files = spark.read.schema(SCHEMA).parquet(folder)
    out = files.join(part_offsets(files), F.col("part") == F.col("at_part")).withColumn("start", F.col("before") + F.col("part_start"))
    return out.select(*(columns or ["doc_id", "start", "n_tokens", "ids"]))


def ids_crc32(files: DataFrame) -> DataFrame:
    """Rows of token files with ids_crc32, of the ids as little-endian unsigned 32-bit integers, instead of the ids."""
    names = ["doc_id", "part", "part_start", "n_tokens"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            offsets = lists.offsets.to_numpy()
            values = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    return files.select(*names, "ids").mapInArrow(digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write the token files of `docs` below the shared folder and return what they hold, one row per document."""
    spark, folder = docs.sparkSession, workspace(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer_path, end_id)
    files = spark.read.schema(SCHEMA).parquet(folder)
    rows = ids_crc32(files).join(part_offsets(files), F.col("part") == F.col("at_part"))
    return rows.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
