import pytest
from pyspark.sql import Row

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens long, part long, chunk long, "
          "size long, label string, kind string, spans string, _text string, key string")


def rows_of(spark, pairs):
    """Documents of (doc_id, text[, source]) with columns whose names operators use themselves."""
    rows = []
    for pair in pairs:
        doc_id, text = pair[:2]
        source = pair[2] if len(pair) > 2 else "a"
        rows.append(Row(doc_id=doc_id, text=text, lang=None, source=source, n_chars=None if text is None else len(text), score=9.0, n_tokens=-1,
                        part=-2, chunk=-3, size=-4, label="x", kind=None, spans="y", _text="z", key=None))
    return spark.createDataFrame(rows, SCHEMA)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    import random
    r = random.Random(seed)
    out = []
    for k in range(n):
        out.append(r.choice(WORDS) + str(r.randint(0, 99)) + ("." if k % 7 == 6 else ""))
    return " ".join(out)


def odd_pairs():
    """Nulls, empty and long texts, ties, repeated rows and ids, non-ASCII and NUL characters."""
    long = prose(1, 4000)
    return [
        (1, prose(2, 200), "a"), (2, prose(2, 200), "b"), (3, None, "a"), (4, "", None), (None, prose(3, 150), "a"), (None, None, None),
        (5, long, "b"), (6, long[:15000], "b"), (7, "été " * 300, "c"), (8, "a\x00b " * 200, "c"), (1, prose(2, 200), "a"), (9, "   \n\t ", "a"),
        (10, "one", "a"), (11, "one", "a"), (12, "x" * 3000, "d"), (5, "another text with this id", "b"), (13, "日本語。テスト！" * 80, "ü"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return rows_of(spark, odd_pairs())


@pytest.fixture(scope="session")
def none(spark):
    return rows_of(spark, []).limit(0) if False else spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
