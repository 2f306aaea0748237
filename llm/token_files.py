"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are range-partitioned and sorted by id, encoded and written one file a range. ORC stores
the ids as run-length encoded integers; stripes can be read in parallel, and a reader that looks for
some documents skips files and stripes by id range, and row groups by range and Bloom filter.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm import words as w
from llm.store import freed_shuffles, new_folder, partitions
from llm.tasks import tidy
from llm.tokens import default_vocabulary, encoder


@dataclass(frozen=True)
class OrcLayout:
    """How the files are laid out."""

    stripe_bytes: int = 64 << 20
    rows_per_index: int = 1000
    bloom_false_positives: float = 0.01
    compression: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "orc.stripe.size": str(self.stripe_bytes),
            "orc.create.index": "true",
            "orc.row.index.stride": str(self.rows_per_index),
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": str(self.bloom_false_positives),
            "compression": self.compression,
        }


ENCODED = "doc_id long, n_tokens long, ids array<int>"


def _encoded(path: str, end_id: int):
    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for piece in w.pieces(batch, "text", 1 << 19):
                ids, starts = coder.encode(piece.column("text"))
                n = len(starts) - 1
                ends = starts[1:] + np.arange(1, n + 1)
                flat = np.full(len(ids) + n, end_id, np.int32)
                inside = np.ones(len(flat), bool)
                inside[ends - 1] = False
                flat[inside] = ids
                offsets = np.r_[0, ends].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(np.diff(offsets).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    ],
                    names=["doc_id", "n_tokens", "ids"],
                )

    return run


def write_tokens(
    docs: DataFrame,
    folder: str,
    vocabulary: str | None = None,
    end_id: int = 1,
    layout: OrcLayout = OrcLayout(),
    text_column: str = "text",
    id_column: str = "doc_id",
) -> None:
    """Write (doc_id, n_tokens, ids) of every row, each text ended by ``end_id``, in ascending id order.

    Null and empty texts are just the end id. Rows with a null id come first; rows that share an id
    stay next to each other in no fixed order. An empty table makes a readable empty folder.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")
    )
    out = (
        texts.repartitionByRange(partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id")
        .mapInArrow(tidy(_encoded(vocabulary or default_vocabulary(), end_id), keep=True), ENCODED)
    )
    with freed_shuffles(spark):
        out.write.options(**layout.options()).orc(folder)


def read_tokens(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; with ``doc_ids`` only those, found by the indexes and Bloom filters."""
    out = spark.read.schema(ENCODED).orc(folder)
    return out if doc_ids is None else out.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _checked(batches):
    for batch in batches:
        ids = batch.column("ids")
        offsets = np.r_[0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
        flat = np.ascontiguousarray(ids.flatten().to_numpy(), "<u4")
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("file"),
                batch.column("doc_id"),
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.array(sums, pa.int64()),
            ],
            names=["file", "doc_id", "n_tokens", "ids_crc32"],
        )


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` is the number of ids before the document in the whole output: ids before it in its file
    and in the files of lower ranges. Only one row a file is ordered in one task.
    """
    stored = read_tokens(spark, folder)
    counts = stored.select(F.col("_metadata.file_path").alias("file"), "doc_id", "n_tokens")
    files = counts.groupBy("file").agg(F.min("doc_id").alias("low"), F.sum("n_tokens").alias("total"))
    before = files.select(
        "file",
        F.coalesce(
            F.sum("total").over(Window.orderBy("low", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    rows = stored.select(F.col("_metadata.file_path").alias("file"), "doc_id", "ids").mapInArrow(
        _checked, "file string, doc_id long, n_tokens long, ids_crc32 long"
    )
    inside = Window.partitionBy("file").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(before, "file")
        .select("doc_id", (F.col("inside") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return token_index(spark, folder)


QUERIES = {"op7_token_output": (op7_token_output, None)}
