import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven eight nine ten".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def odd_rows(rng):
    """Nulls in any column, empty and long texts, ties, repeated rows, and texts
    of little but control strings and white space."""
    base = prose(rng, 60)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, "a", 3), (4, "one", "en", None, 3), (5, "one two", None, None, 7),
        (6, base, "en", "a", 10), (7, base, "en", "b", 10), (7, base, "en", "b", 10), (8, base.upper(), "fr", "b", None), (9, base + " tail", "en", "a", 1),
        (10, "<|endoftext|> x <|endoftext|>", "en", "a", 1), (11, "é" * 50 + " ünï", "fr", "c", 1), (12, "a\x0bb\x0cc d", "en", "c", 1),
        (13, "word " * 30000, "en", "a", 1), (14, prose(rng, 4000), "en", "a", 1), (None, "no id at all", "en", "a", 1), (15, "x" * 20000, "en", "a", 1),
        (16, "\n".join(["a line of words here"] * 6), "en", "a", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    rng = random.Random(5)
    rows = odd_rows(rng)
    texts = [prose(rng, rng.randrange(25, 120)) for _ in range(60)]
    for i, t in enumerate(texts):
        rows.append((100 + i, t, rng.choice(["en", "fr"]), rng.choice(["a", "b", None]), len(t)))
    for i in range(30):  # near copies, some of near copies
        w = rng.choice(texts[:8]).split()
        w[rng.randrange(len(w))] = f"new{i}"
        texts.append(" ".join(w))
        rows.append((200 + i, texts[-1], "en", "a", 1))
    # extra columns, some with names that operators use
    df = spark.createDataFrame([(*r, 1, "z", True, 0.5) for r in rows], SCHEMA + ", size int, class string, kept boolean, distance double")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", size int")
