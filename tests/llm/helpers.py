"""Small tables with the awkward cases that every operator must survive."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def table(spark, texts, ids=None, langs=None, sources=None, partitions=3):
    n = len(texts)
    rows = list(zip(ids or list(range(n)), texts, langs or ["en"] * n, sources or ["s"] * n, [len(t or "") for t in texts], strict=True))
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


AWKWARD = [
    None,
    "",
    "   \n\t ",
    "one",
    "one two",
    "A b c d e é ü ñ 漢字 😀 tail",
    "same words again " * 40,
    "same words again " * 40,
    "x" * 70000 + " end",
    "lorem ipsum dolor sit amet " * 3000,
    "\x00 nul \x0b vt",
]
AWKWARD_IDS = [0, None, 2, 3, 3, 5, 6, 7, 8, None, 10]
