"""What the operators of this subpackage share: reading, Arrow batches, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.storage import checkpoint, checkpoint_folder, remove, scratch  # noqa: F401  (the operators take them from here)

#: Rows and bytes of one Arrow batch handed to Python. Long texts reach the byte limit first.
BATCH_ROWS = 2000
BATCH_BYTES = 2 << 20
#: Characters of a long text that are split into words at once.
PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def keep_ids(docs: DataFrame, stay: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is in the one column of ``stay``, null among them."""
    name = fresh(docs, "stay_id")
    ids = stay.toDF(name).distinct()
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that a Python worker never holds many long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def word_pieces(text: str, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, those of some ``piece`` characters at a time: white are the six characters at which bytes are split."""
    at = 0
    while at < len(text):
        end = at + piece
        while end < len(text) and text[end] not in " \t\n\v\f\r":
            end += 1
        yield text[at:end].encode().split()
        at = end


def map_texts(
    docs: DataFrame,
    rows: Callable[[list, list], list],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Apply ``rows(ids, texts) -> one list per output column`` to whole texts in Arrow batches.

    A null text counts as empty. Only the two columns named reach Python, so extra columns, whatever
    their names, do no harm.
    """
    arrow_batches(docs.sparkSession)
    spark_schema = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(spark_schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = rows(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, target, strict=True)], schema=target
            )

    picked = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return picked.mapInArrow(run, spark_schema)
