"""Small tables with what an operator has to bear: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem ipsum dolor sit amet " * 40_000

ODD = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, LONG, "en", "a", len(LONG)), (4, LONG, "en", "b", len(LONG)),
    (5, "same words here again", "en", "a", 21), (6, "same words here again", "en", "a", 21), (6, "same words here again", "en", "a", 21),
    (7, "x" * 50_000, "en", "a", 50_000), (8, " \n\t ", "en", "a", 4), (None, "no id at all", "en", "a", 12), (9, "Ünï çødé 😀 漢字 <|endoftext|> it's", "de", "c", 30),
]

#: Columns whose names the operators use inside.
EXTRA = ", _id string, _text string, _row string, _slot string, _source string, _key string, _y int, _tidemark_key string, host string, evidence string, recipe string, fp bigint, spans string, score string, node bigint"


def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ODD, COLUMNS)


def clashing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, *["z"] * 6, 1, "z", "z", "z", "z", 5, "z", "z", 3) for r in ODD], COLUMNS + EXTRA)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COLUMNS)


def labels(spark: SparkSession, rows=()) -> DataFrame:
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def documents(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def lines_run(f):
    """What ``f`` returns, and how many lines of Python ran for it: work that no clock and no other load changes."""
    count = 0

    def trace(frame, event, arg):
        nonlocal count
        count += event == "line"
        return trace

    sys.settrace(trace)
    try:
        return f(), count
    finally:
        sys.settrace(None)
