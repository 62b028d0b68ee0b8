"""Tables written between steps, and join sides whose size is checked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.session import shared_folder

#: Bytes up to which a counted table is broadcast.
BROADCAST_BYTES = 16 << 20
#: Rows of a range, in which a task holds a sort and the rows of a window at once.
RANGE_ROWS = 250_000


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: lineage is cut and its size is known."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, width: int = 256, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, cheap to count, with a broadcast hint where its rows at `width` bytes fit the limit, else a merge hint."""
    return F.broadcast(df) if df.limit(limit // width + 1).count() * width <= limit else df.hint("merge")


def ranges_of(df: DataFrame) -> int:
    """The number of ranges for a written table: as many as a shuffle has, or more, so that a range doesn't grow with the table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
