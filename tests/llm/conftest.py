import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "123 456 %%% ..."), (5, "word " * 60_000), (6, "The same text twice."),
    (6, "The same text twice."), (None, "A row without an id."), (7, "x" * 200_000), (8, "▁ two  spaces ▁"),
    (9, " leading and trailing "), (10, "<|endoftext|> a<|endoftext|>b <s> </s>"), (11, "Ünïcode ﬁ é 日本語 \u2028 x"),
    (12, "THE SAME text twice."), (13, "a\x00b \x1c c"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """NULLs, empty and very long texts, repeated rows, and further columns with names the operators use."""
    frame = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    return frame.select(
        "*", F.when(F.col("doc_id") % 2 == 0, "en").alias("lang"), F.lit("s").alias("source"),
        F.length("text").cast("long").alias("n_chars"),
        *[F.lit(i).alias(c) for i, c in enumerate(
            ("fp", "score", "component_id", "item_id", "length", "first", "key", "n", "a", "b", "t", "held_out", "tiles"))])


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
