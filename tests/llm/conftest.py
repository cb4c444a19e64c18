import random

import pytest

WORDS = [f"{a}{b}{c}" for a in "bcdfgl" for b in ("a", "é", "ou") for c in ("n", "s", "tt", "")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, block string, label string, size double"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def messy(seed=1):
    """Documents with nulls, empty and blank texts, one very long text, copies, near copies, shared passages, ties."""
    rng = random.Random(seed)
    base, passage, fuzzy = sentence(rng, 300), sentence(rng, 70), sentence(rng, 90).split()
    texts = [sentence(rng, rng.choice([1, 3, 8, 15, 40, 200])) for _ in range(40)]
    texts += [base, base, base.upper(), base.replace(" ", "\n"), None, "", " \t\n", "x", "a b", "a b", "#$ %& <b>"]
    for k in range(6):
        w = base.split()
        w[10 + k * 40] = "edited"
        texts.append(" ".join(w))
        g = list(fuzzy)
        g[20 + k], g[60 - k] = "changed", "again"
        texts.append(sentence(rng, 30) + " " + passage + " " + sentence(rng, 20))
        texts.append(sentence(rng, 25) + "\n" + " ".join(g) + " " + sentence(rng, 10))
    texts.append(sentence(rng, 20_000))
    texts.append("\n".join(["the same line again and again here"] * 9))
    texts.append("<|endoftext|> it's  two  spaces\u00a0é\u0301 日本 \x1c\r\n'll <|startoftext|>" * 3)
    rows = [(i, t, (None, "en", "fr")[i % 3], (None, "", "a", "b", "b", "b", "z")[i % 7], len(t) if t else 0, 7, "x", None, 1.5) for i, t in enumerate(texts)]
    rows.append(rows[41])  # a repeated row
    rows.append((None, texts[2], "en", "a", 1, 7, "x", None, 1.5))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return messy()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
