import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 40, n), strict=True))


@pytest.fixture
def make_docs(spark):
    """Documents from (id, text), with more columns, some of which bear names that operators use themselves."""

    def make(rows, clashing=True):
        df = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], DOCS)
        if clashing:
            df = df.withColumn("score", F.lit("no")).withColumn("items", F.lit(1)).withColumn("hashes", F.lit("h"))
            df = df.withColumn("class", F.lit("c")).withColumn("n_words", F.lit("w")).withColumn("label", F.lit("l"))
        return df

    return make


@pytest.fixture
def odd_texts():
    """Null, empty, blank, very long, sign-only and repeated texts."""
    rng = np.random.default_rng(3)
    long = prose(rng, 30_000)
    return [None, "", " \n\t ", "a", "!!! ***", long, long, "x" * 60_000, "ß€ 漢字 😀", "repeat me now", "repeat me now", "\x00 \x1f ", "A" * 3]


@pytest.fixture
def text_of():
    return prose
