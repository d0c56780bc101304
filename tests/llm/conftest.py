from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, size long, ids string, `__row` long"


def words(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{rng.randrange(size):x}k" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids."""
    rng = random.Random(5)
    long_ = words(rng, 60_000)
    plain = words(rng, 80)
    texts = [None, "", "   \n\t ", "one", "a b c", plain, plain, long_, "Straße ÉCOLE 中文 字 ok.", "x" * 50_000, "... !!! ???", " lead", "trail ", "two  spaces \n here", "<|endoftext|> don't"]
    out = [(i, t, ["en", None, "fr"][i % 3], ["s1", None, "s2", ""][i % 4], i, 0.5, 7, 8, "i", 9) for i, t in enumerate(texts)]
    return [*out, out[5], (None, plain, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (5, "other text of the same id", "en", "s1", 1, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows, tmp_path_factory):
    """The odd rows as a table read from files."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def table_of(spark, tmp_path):
    """Writes rows as a table of files and reads it."""

    def make(rows: list[tuple], schema: str = "doc_id long, text string, lang string, source string", parts: int = 3):
        path = str(tmp_path / f"t{random.random()}.parquet")
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    return make
