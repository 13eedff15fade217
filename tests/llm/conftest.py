import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, shard int, component string, __c0 string"


def made_documents():
    """Short texts with all that operators must stand: nulls, empty and very long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(70), text(120).split()
    texts = [text(rng.randint(1, 90)) for _ in range(30)]
    for i in range(12):  # near copies
        copy = base.copy()
        copy[rng.randrange(len(copy))] = f"edit{i}"
        if i % 3 == 0:
            copy[5 * i + 3] = "more"
        texts.append(" ".join(copy))
    texts += [f"{text(20)}\n{passage}  {text(15)}" for _ in range(6)] + [texts[3]] * 4 + [passage.upper()]
    texts += ["", "   \n\t", "one", "two words", "two words", "it's <|endoftext|> ÄÖß İ é x́ 日本 １２ ½", None, None, text(9000), "a b c d e " * 40]
    rows = [(i * 3, t, "de", f"src{i % 3}" if i % 7 else None, None if t is None else len(t), i, "x", "y") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[5], None, "src0", 1, 0, None, None), (None, None, None, None, None, None, None, None), (6, texts[9], "en", "src1", 2, 2, "x", "y")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return made_documents()


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)
