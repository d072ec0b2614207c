import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int, lang: str = "en") -> str:
    """Invented prose: syllables differ by language."""
    stock = {"en": "th er on an re he in ed nd ha", "de": "sch ein ung ver keit ge be zu au ch", "fr": "eau oi que ré ment le ai ou è tion"}
    rng, parts = random.Random(f"{seed}{lang}"), stock[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def lines(seed: int, n: int, lang: str = "en") -> str:
    return "\n".join(words(seed * 1000 + i, 12, lang) for i in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, repeated rows, one key with two texts."""
    rows = [(i, lines(i, 8, lang), lang, f"src{i % 4}", 1) for i, lang in enumerate(["en", "de", "fr"] * 6)]
    rows += [
        (100, None, "en", "src0", None), (101, "", "en", "src0", 0), (102, " \t\n", "de", None, 3),
        (103, "12 345 !!", None, "src1", 9), (104, "Éa", "fr", "src2", 2), (105, lines(7, 9000), "en", "src0", 1),
        (106, lines(1, 8), "en", "src0", 1), (106, lines(1, 8), "en", "src0", 1), (107, lines(50, 9), "en", "src3", 1),
        (107, lines(51, 9), "en", "src3", 1), (None, lines(52, 9), "de", "src3", 1), (None, None, None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows above with extra columns named like ones the operators add."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(awkward_rows(), DOCS)
    clashing = ["score", "fingerprint", "ids", "kept", "spans", "shard", "tie", "key", "row", "component_id", "place", "label"]
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in clashing])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def work(spark, tmp_path_factory):
    return tmp_path_factory.mktemp("llm")


@pytest.fixture(scope="session")
def folder(work):
    """Write tables as a folder of Parquet files, the way queries read them."""

    def write(name: str, **tables) -> str:
        for table, df in tables.items():
            df.coalesce(2).write.mode("overwrite").parquet(f"{work}/{name}/{table}.parquet")
        return f"{work}/{name}"

    return write
