"""Tables of the catalog, and CSV files with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Columns are bound by the names in the header and cast to the schema; what can't be cast is null."""
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    text = spark.read.option("header", True).csv(path)
    return text.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in text.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])
