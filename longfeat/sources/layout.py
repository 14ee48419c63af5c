"""Products laid out by person once: bucketed, sorted tables that later steps read without an exchange.

A stored table has ``buckets`` files, each with all rows of its persons, sorted. Whatever groups, windows or joins by
person afterwards starts from that distribution, so a product used by several steps is shuffled once, when it is
written. Two tables meet without an exchange if they have the same number of buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from longfeat.sources.storage import fresh_path, remove

#: Bytes that a bucket should hold; a bucket is one task later.
BUCKET_BYTES = 128 << 20


def bucket_count(spark: SparkSession, total_bytes: int, least: int | None = None) -> int:
    """Buckets for so many bytes: as many tasks as the session shuffles to at least, a multiple of it beyond."""
    least = least or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return least * max(1, -(-total_bytes // (BUCKET_BYTES * least)))


def row_bytes(df: DataFrame) -> int:
    """What a row of fixed-width columns holds in a task: 8 bytes a field and 16 for the row; texts count as 32."""
    return 16 + sum(32 if isinstance(f.dataType, (T.StringType, T.BinaryType)) else 8 for f in df.schema)


def store_by_person(df: DataFrame, name: str, buckets: int, key: str = "person_id", order: Sequence[str] = ("day",)) -> str:
    """Write ``df`` once, bucketed by ``key`` and sorted inside; the name of the table comes back.

    The rows are dealt to as many tasks as there are buckets by the hash that buckets use, so a task writes one file.
    The files lie in the session's shared folder.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    order = [c for c in order if c in df.columns]
    dealt = df.repartition(buckets, key)
    writer = dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key, *order)
    writer.option("path", fresh_path(df.sparkSession, name)).saveAsTable(table)
    return table


def stored(df: DataFrame, name: str, buckets: int, key: str = "person_id", order: Sequence[str] = ("day",)) -> DataFrame:
    """The stored table of ``store_by_person``, read again."""
    return df.sparkSession.table(store_by_person(df, name, buckets, key, order))


def drop_stored(spark: SparkSession, table: str) -> None:
    """Forget a stored table and remove its files."""
    described = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Location'").first()
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    if described:
        remove(spark, described.data_type)
