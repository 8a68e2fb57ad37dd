from __future__ import annotations

import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()),
                   StructField("n_chars", LongType())])
LABELS = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())])


@pytest.fixture
def docs(spark):
    """docs([(doc_id, text, lang, source), ...], extra={name: value}) -> DataFrame with the columns of documents."""
    def make(rows, **extra):
        full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in (r if len(r) == 4 else (*r, "en", "s") for r in rows)]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        from pyspark.sql import functions as F
        return df.withColumns({k: F.lit(v) for k, v in extra.items()})
    return make


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame([(i, q, 0) for i, q in rows], LABELS)
    return make
