import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, `q.x` string, row int, ids string, size int, key int, media string, shard int"


@pytest.fixture(scope="session")
def table(spark):
    """Builds documents with extra columns whose names the operators use themselves."""

    def build(texts, sources=None, ids=None):
        rows = [
            (i if ids is None else ids[i], t, "en", None if sources is None else sources[i], None if t is None else len(t), 7, "n", "x", 1, "i", 2, 3, "m", 4)
            for i, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, SCHEMA)

    return build


LONG = " ".join(f"word{i % 977} tail{i % 31}," for i in range(60_000))
ODD = [None, "", " ", "\n\n", "a", "a b c d", "a b c d e", "a b c d e", "x  y\t\tz \n q", "naïve café — 日本語テスト", "\x1c odd\x00 bytes", LONG, LONG]


@pytest.fixture(scope="session")
def odd():
    return ODD
