import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row_no long, digest string, words string, place string"


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def fixture_rows():
    """Copies, near copies, shared passages, nulls, empty, one-word and very long texts, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    texts = [prose(rng, rng.randint(60, 220), vocabulary) for _ in range(30)]
    passage = prose(rng, 64, vocabulary)
    for i in (2, 5, 9):
        words = texts[i].split()
        texts[i] = " ".join([*words[:20], passage, *words[20:]])
    for i in range(8):  # near copies
        words = texts[i].split()
        for _ in range(max(1, len(words) // 40)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(99))
        texts.append(" ".join(words))
    texts += [texts[3], texts[3].upper(), texts[4], texts[3], "", None, "  \n", "one", "One", "1234 !!", "Ünï é ñ", "x " * 300, prose(rng, 9000, vocabulary), "a\nb c  d"]
    rows = []
    for i, t in enumerate(texts):
        lang = None if i % 11 == 7 else ("en" if i % 2 else "fr")
        rows.append((i, t, lang, None if i % 9 == 4 else f"s{i % 4}", None if i % 5 == 0 else 3, 7, i, "d", "w", "p"))
    rows += [rows[3], rows[0], (None, texts[1], "en", "s0", 1, 1, 1, None, None, None), (None, None, None, None, None, None, None, None, None, None), (-100, "a b c", "fr", "s1", 0, 0, 0, "", "", "")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return fixture_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, DOC_SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
