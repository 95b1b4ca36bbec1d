import pytest

#: Names that operators use inside, put on the input to clash with them.
CLASH = ["mark", "fp", "node", "h", "k", "n", "spans", "lang_pred", "score", "key", "bucket", "s", "e", "shard", "hits", "parts", "root", "email", "_email", "length", "prompt", "value"]


def edge_rows():
    prose = "the quick brown fox jumps over the lazy dog and then runs away from the big bad wolf"
    long_ = " ".join(f"word{i % 977} and{i % 31}" for i in range(20_000))
    return [
        (0, prose),
        (1, None),
        (2, ""),
        (3, " \n\t \n"),
        (4, long_),
        (5, prose),
        (5, prose),
        (6, "12345 67890 !!"),
        (None, prose + " again"),
        (7, "x"),
        (8, "a\x00b é ü 日本語 😀"),
        (9, "z" * 50_000),
        (10, long_[:3000] + " tail of another kind " + long_[9000:12000]),
        (11, None),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") != 0, "en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")
