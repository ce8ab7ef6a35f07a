"""Small tables for the operator tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark: SparkSession, texts, lang="en", source="s") -> DataFrame:
    """Documents with ids from 0, or from (id, text) pairs."""
    pairs = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in pairs], SCHEMA)


#: Texts that every operator must take: null, empty, blank, one word, repeated, very long, other scripts.
AWKWARD = [None, "", " \n\t ", "word", "word", "a b c " * 40_000, "x" * 200_000, "Ünïcödé 漢字 İıſ ﬁ ́", "123 456!"]
