"""Readers: named table sets, inline rows, deterministic subsets, type conformance."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longfeat.sources.schemas import (
    FOLDERS,
    OPERATOR_COLUMNS,
    OTHER_TABLES,
    PERSON_FILES,
    PERSON_TABLES,
    VOCABULARY_FILES,
    VOCABULARY_TABLES,
    struct,
)


def load_tables(
    spark: SparkSession,
    root: str,
    specs: Mapping[str, str | T.StructType],
    fmt: str = "csv",
    files: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Read one table per spec entry under ``root``; ``files`` maps a table to another file name.

    The schema is declared, so no pass over the data is needed to infer it and two roots never disagree on types.
    """
    files = files or {}
    tables = {}
    for name, spec in specs.items():
        schema = struct(spec) if isinstance(spec, str) else spec
        path = f"{root.rstrip('/')}/{files.get(name, f'{name}.{fmt}')}"
        reader = spark.read.schema(schema)
        if fmt == "csv":
            reader = reader.option("header", True).option("sep", ",").option("enforceSchema", False)
        tables[name] = reader.format(fmt).load(path)
    return tables


def declared(names: Iterable[str]) -> dict[str, str]:
    """The declared schemas of the tables."""
    known = {**PERSON_TABLES, **VOCABULARY_TABLES, **OTHER_TABLES}
    return {name: known[name] for name in names}


def load_layout(
    spark: SparkSession, root: str, folders: Mapping[str, str] = FOLDERS, fmt: str = "csv"
) -> dict[str, dict[str, DataFrame]]:
    """The published layout as it is: ``train`` and ``test`` person tables and the ``vocabulary``, by our table names.

    A file may have further columns or another column order: fields are found by the names in its header, and one
    that it lacks is null.
    """
    loaded = {}
    for part, folder in folders.items():
        files = VOCABULARY_FILES if part == "vocabulary" else PERSON_FILES
        place = root.rstrip("/") if folder == "." else f"{root.rstrip('/')}/{folder}"
        loaded[part] = {}
        for name, spec in declared(files).items():
            path = f"{place}/{files[name]}.{fmt}"
            whole = spark.read.option("header", True).format(fmt).load(path)
            absent = {f.name: F.lit(None) for f in struct(spec) if f.name not in whole.columns}
            loaded[part][name] = conform(whole.withColumns(absent), spec)
    return loaded


def operator_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The same tables under the column names the operators use."""
    return {name: df.withColumnsRenamed(OPERATOR_COLUMNS.get(name, {})) for name, df in tables.items()}


def inline(spark: SparkSession, rows: Iterable[Sequence], schema: str | T.StructType) -> DataFrame:
    """Configuration rows as a DataFrame."""
    return spark.createDataFrame(list(rows), schema)


def first_rows(df: DataFrame, n: int, by: str = "person_id", ties: Sequence[str] = ()) -> DataFrame:
    """The first n rows by key; ``ties`` makes the choice repeatable."""
    return df.orderBy(by, *ties).limit(n)


def subset_rows(tables: Mapping[str, DataFrame], n: int = 10_000, by: str = "person_id") -> dict[str, DataFrame]:
    """First n rows of every table (other columns break ties)."""
    return {k: first_rows(t, n, by, [c for c in t.columns if c != by]) for k, t in tables.items()}


def subset(tables: Mapping[str, DataFrame], n: int = 10_000, by: str = "person_id", of: str | None = None):
    """All rows of the first n keys, so the tables stay consistent. The n keys are the broadcast bound."""
    source = tables[of or next(iter(tables))]
    keys = source.select(by).where(F.col(by).isNotNull()).distinct().orderBy(by).limit(n)
    return {k: t.join(F.broadcast(keys), by, "left_semi") for k, t in tables.items()}


def conform(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Project onto a schema by name; a value that does not parse becomes null."""
    schema = struct(schema) if isinstance(schema, str) else schema
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def refused_values(df: DataFrame, schema: str | T.StructType) -> list[Column]:
    """For each field a count of the values that are there but do not parse (aggregates over the rows before conform)."""
    schema = struct(schema) if isinstance(schema, str) else schema
    bad = lambda f: F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
    return [F.count_if(bad(f)).alias(f.name) for f in schema.fields]


def conform_counted(df: DataFrame, schema: str | T.StructType, name: str) -> tuple[DataFrame, Observation]:
    """``conform``, and an observation that any action on the result fills: ``rows`` and the refused values per field.

    The counts come from the same pass that writes or aggregates the conformed rows. The observed frame must be read
    to its end by one action; ``observation.get`` waits for it.
    """
    schema = struct(schema) if isinstance(schema, str) else schema
    seen = Observation(name)
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *refused_values(df, schema))
    return conform(counted, schema), seen


def refused(df: DataFrame, schema: str | T.StructType, table: str) -> DataFrame:
    """(table_name, column_name, rows, refused): a row for each field, from one aggregate."""
    schema = struct(schema) if isinstance(schema, str) else schema
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(f"__{i}") for i, c in enumerate(refused_values(df, schema))])
    lines = [F.struct(F.lit(f.name).alias("column_name"), F.col("rows"), F.col(f"__{i}").alias("refused")) for i, f in enumerate(schema.fields)]
    return row.select(F.lit(table).alias("table_name"), F.inline(F.array(*lines)))
