"""Sinks and written tables: results, fit-time statistics, models, materialised products."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longfeat.sources.schemas import struct
from longfeat.sources.tables import inline


_local_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it in ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a temporary folder of its own.
    """
    key = "spark.checkpoint.dir"
    named = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="longfeat-")
    return _local_folders[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: Sequence[str] = ()
) -> str:
    """Write a result; CSV gets a header line."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a product once to the shared folder and read it back: later uses survive lost executors and share it."""
    path = write_table(df, fresh_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_strict(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """A CSV file as (rows that fit the schema, refused lines as they stand in the file), by a corrupt-record column.

    A line with too few or too many fields or a value that does not parse is refused whole and never lost. The file is
    parsed once; the parsed rows are written to the shared folder, and both results read them.
    """
    schema = struct(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*schema.fields, T.StructField("__line", T.StringType())])
    reader = spark.read.schema(wide).option("header", header).option("mode", "PERMISSIVE").option("enforceSchema", False)
    parsed = materialize(reader.option("columnNameOfCorruptRecord", "__line").csv(path), "parsed")
    fine = parsed.where("__line is null").select(*schema.names)
    return fine, parsed.where("__line is not null").select(F.col("__line").alias("line"))


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a written table or folder, in whatever store it lies; False where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def save_stats(df: DataFrame, path: str) -> str:
    """Fit-time statistics (minima, maxima, kept columns), overwritten by the next fit."""
    return write_table(df, path, mode="overwrite")


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_columns(spark: SparkSession, columns: Sequence[str], path: str) -> str:
    """Training columns in order."""
    rows = inline(spark, list(enumerate(columns)), "position int, column_name string")
    return write_table(rows.coalesce(1), path, mode="overwrite")


def load_columns(spark: SparkSession, path: str) -> list[str]:
    return [r.column_name for r in spark.read.parquet(path).orderBy("position").collect()]


def save_models(models: Mapping[str, PipelineModel], root: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{root.rstrip('/')}/{name}")


def load_models(root: str, names: Sequence[str]) -> dict[str, PipelineModel]:
    return {name: PipelineModel.load(f"{root.rstrip('/')}/{name}") for name in names}
