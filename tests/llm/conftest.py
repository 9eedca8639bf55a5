import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shingles string, component string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ids without value, clashing extra columns."""
    rows = [
        (1, "hello world this is a plain text", "en", "s", 10, "x", "y"),
        (1, "hello world this is a plain text", "en", "s", 10, "x", "y"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "s", 0, "", ""),
        (None, "an id is missing here, call +1 (555) 555-0100", "en", "s", 1, "", ""),
        (None, None, None, None, None, None, None),
        (4, " \t\n ", "en", "s", 3, "", ""),
        (5, "😀 élan Straße 日本語 <|endoftext|> \x00 a b", "fr", "s", 9, "", ""),
        (6, "word " * 60_000, "en", "s", 300_000, "", ""),
        (7, "1234567890 .,;!", "en", "s", 15, "", ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def near_copies():
    """(doc_id, text): families of edited copies, exact copies and single texts."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    docs, n = [], 0
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([8, 30, 80, 200]))]
        for _ in range(rnd.randint(1, 14)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 14))):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            docs.append((n, "  ".join(w.upper() if rnd.random() < 0.1 else w for w in own)))
            n += 1
    docs += [(n + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40)))) for i in range(20)]
    return docs
