"""Readers for raw card-transaction exports (declared schema, no inference)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerlens.schema import RAW_COLUMNS, RAW_SCHEMA

# columns that stay text in the raw layout but must parse when the table is prepared
PARSED = {"trans_date_trans_time": "timestamp_ntz", "dob": "date"}
MALFORMED = "malformed row"
_CORRUPT = "_corrupt_record"


def read_raw(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """Read one raw export with the declared schema.

    CSV is read with its header, every column as text (no ``inferSchema``
    pass over the data), then the declared columns are selected by name and
    cast, so exports with extra or reordered columns load unchanged. Parquet
    columns are selected by name and cast the same way; unused columns are
    pruned from the scan. Under ANSI mode (the Spark 4 default) a malformed
    value fails the job instead of turning into NULL.
    """
    if fmt == "csv":
        opts = {"header": "true", "mode": "FAILFAST", **options}
        df = spark.read.options(**opts).csv(path)
    elif fmt == "parquet":
        df = spark.read.options(**options).parquet(path)
    else:
        df = spark.read.format(fmt).options(**options).load(path)
    return conform_raw(df)


def conform_raw(df: DataFrame) -> DataFrame:
    """Project and cast a raw frame to the declared raw layout (by column name)."""
    missing = [c for c in RAW_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"raw table lacks columns: {missing}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields])


def read_raw_checked(spark: SparkSession, path: str, fmt: str = "csv", **options) -> tuple[DataFrame, DataFrame]:
    """Read one raw export without failing on bad values: (good rows in the raw layout, rejects).

    See :func:`checked_raw`. CSV rows with too few or too many fields are rejected as a whole.
    """
    if fmt != "csv":
        return checked_raw(spark.read.format(fmt).options(**options).load(path))
    opts = {"header": "true", **options}
    fields = [StructField(c, StringType()) for c in spark.read.options(**opts).csv(path).columns]
    schema = StructType([*fields, StructField(_CORRUPT, StringType())])
    return checked_raw(spark.read.schema(schema).options(**{**opts, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).csv(path), _CORRUPT)


def checked_raw(df: DataFrame, corrupt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split a raw frame: (good rows, cast as :func:`conform_raw` does; rejects).

    A row is rejected if a value that is there cannot be cast to its declared type, or a time or birth date cannot be parsed; nulls are
    no fault. Rejects: ``reasons`` (array of ``bad <column>`` or ``malformed row``), ``record`` (the row's values as JSON, or the raw line) and
    ``file``. One narrow pass per result: no shuffle, every value is tried with ``try_cast``.
    """
    missing = [c for c in RAW_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"raw table lacks columns: {missing}")

    def bad(name: str, kind) -> Column:
        return F.when(F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull(), F.lit(f"bad {name}"))

    tried = [bad(f.name, PARSED.get(f.name, f.dataType)) for f in RAW_SCHEMA.fields if f.name in PARSED or f.dataType != StringType()]
    whole = F.lit(False) if corrupt is None else F.col(corrupt).isNotNull()
    # the fields of a malformed row stand in the wrong columns, so nothing more is said of it
    reasons = F.when(whole, F.array(F.lit(MALFORMED))).otherwise(F.array_compact(F.array(*tried)))
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != corrupt]))
    record = record if corrupt is None else F.coalesce(F.col(corrupt), record)
    marked = df.withColumn("_reasons", reasons)
    good = marked.where(F.size("_reasons") == 0).select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields])
    rejects = marked.where(F.size("_reasons") > 0).select(F.col("_reasons").alias("reasons"), record.alias("record"), F.input_file_name().alias("file"))
    return good, rejects


def load_raw(spark: SparkSession, path: str, rejects_path: str, fmt: str = "csv", **options) -> DataFrame:
    """The good rows of an export; its rejects are written to ``rejects_path`` (Parquet) first."""
    good, rejects = read_raw_checked(spark, path, fmt, **options)
    rejects.write.mode("overwrite").parquet(rejects_path)
    return good
