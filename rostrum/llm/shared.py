"""Small helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.session import shared_folder

#: Bytes up to which a counted table is broadcast; beyond it, the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Rows and characters of text that a task works on at a time.
PIECE_ROWS, PIECE_CHARS = 1024, 1 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: lineage is cut and its size is known."""
    return _write(df, name)[0]


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Written tables that nothing needs once a later one is written; drop() deletes them from the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        table, path = _write(df, name)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, or all that are left."""
        for table in tables or [t for t, _ in self.paths.values()]:
            _, path = self.paths.pop(id(table))
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def row_bytes(df: DataFrame) -> int:
    """About what a row takes in a broadcast table: its fixed-width columns, 80 bytes for each other one, 32 besides."""
    return 32 + sum({"bigint": 8, "double": 8, "int": 8, "timestamp": 8, "boolean": 8, "date": 8}.get(t, 80) for _, t in df.dtypes)


def sized(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_BYTES, width: int | None = None, other: str = "merge") -> DataFrame:
    """`df` with a join hint that follows its counted size: broadcast up to `limit` bytes (`width` a row, estimated
    from the columns where it isn't given), else a sort-merge join, whose skewed keys adaptive execution splits. `df`
    must be cheap to count, such as a written table."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * (width or row_bytes(df)) <= limit else df.hint(other)


def pieces(batches: Iterator[pd.DataFrame], column: str = "text", rows: int = PIECE_ROWS, chars: int = PIECE_CHARS) -> Iterator[pd.DataFrame]:
    """The rows of Arrow batches in pieces of up to `rows` rows and about `chars` characters of `column`; a longer
    text is a piece of its own. What a task holds for a piece is bounded by the piece, not by the batch."""
    for batch in batches:
        size = batch[column].str.len().fillna(0).to_numpy(np.int64).cumsum()
        begin = 0
        while begin < len(batch):
            before = size[begin - 1] if begin else 0
            end = max(begin + 1, min(begin + rows, int(np.searchsorted(size, before + chars, side="right"))))
            yield batch.iloc[begin:end]
            begin = end


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of doc_id's decimal text is divisible by `folds` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def clear_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
