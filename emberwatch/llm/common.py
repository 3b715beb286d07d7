"""What the corpus operators share: session settings, tables, the shared folder, let-bindings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.session import ship_code, tune, work_dir

#: Texts are long: few of them, and few bytes, go to a Python worker at a time.
TEXT_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}

#: `[\x20\x09-\x0D]`, the white space of the word and line definitions.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tune_for_texts(spark: SparkSession) -> SparkSession:
    tune(spark)
    ship_code(spark)
    for key, value in TEXT_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune_for_texts(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: worked out once, readable after an executor is lost."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """The column of this name, whatever dots or quotes are in it."""
    return F.col("`%s`" % name.replace("`", "``"))


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, ``row``, so that none of their names can clash."""
    return docs.select("doc_id", "text", F.struct(*(quoted(c).alias(c) for c in docs.columns if c != "text")).alias("row"))


def unpacked(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns that went into ``packed``, with another text."""
    return rows.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row, however often the body names it.

    A plain Column is a formula: the optimizer may copy it to each place that
    names it, into the lambdas of array functions too. A lambda's variable is a value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does the same, faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """A content hash that tells rows apart which share a ``doc_id``; 0 for a null text."""
    return F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text))
