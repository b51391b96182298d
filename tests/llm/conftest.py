import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(*texts, start=0, lang="en", source="a"):
    return [(start + k, t, lang, source, None if t is None else len(t)) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    def docs(*texts, **options):
        return spark.createDataFrame(rows(*texts, **options), SCHEMA)

    return docs


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, ids with several texts, and columns whose names operators use themselves."""
    rnd = random.Random(5)
    long = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "Été", "ÖL."]) + str(rnd.randrange(900)) for _ in range(12_000))
    data = rows("", None, "   ", "one two", "ONE two", "one two three four five six", long, long.lower(), "İ ß Å ﬁ", "日本語 テキスト", "x" * 5000)
    data += [data[3], data[3], (None, "one two", None, None, None), (None, None, None, None, None), (50, "one two", None, None, 7)]
    data += [(3, "one two three", "en", "a", 13), (5, "another text of this very id", "de", "b", 28), (50, long + " more", "en", None, 1), (6, "one TWO three", "en", "a", 13)]
    clash = "size int, hash string, quality_score string, n_tokens string, _row int, _hash int, _keep int, shard int, lang_pred int, component_id int, cls int, th long, key string, _times int, part int, bucket int"
    return spark.createDataFrame([(*r, *[1 if c.endswith(("int", "long")) else "s" for c in clash.split(", ")]) for r in data], f"{SCHEMA}, {clash}")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
