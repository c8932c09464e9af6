import random

import pytest

#: Columns of documents, and more whose names the operators use for themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, key long, row string, comp long, n long, block string"


def table(spark, pairs, lang="en", source="s"):
    """pairs: (doc_id, text)."""
    rows = [(i, t, lang, source, len(t or ""), None, 1, "x", None, 2, "b") for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, words=200):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 9))) for _ in range(words)]
    return " ".join(rng.choices(vocabulary, k=n))


def near(text, seed, edits):
    rng = random.Random(seed)
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "".join(rng.choices("xyz", k=6))
    return " ".join(words)


@pytest.fixture(scope="session")
def odd_pairs():
    """Nulls, empty and long texts, ties, repeated rows, copies, near copies, shared passages."""
    base = [prose(k, 120, 3000) for k in range(12)]
    passage = prose(99, 60, 3000)
    pairs = list(enumerate(base))
    pairs += [(20 + k, near(base[0], k, 1 + k % 6)) for k in range(30)]
    pairs += [(60 + k, f"{prose(200 + k, 40, 3000)} {passage} {prose(300 + k, 30, 3000)}") for k in range(8)]
    pairs += [(80, None), (81, ""), (82, " \t\n"), (83, "one"), (84, "One"), (85, "one two three"), (86, "日本 語" * 40), (87, "日本 語" * 40 + "x")]
    pairs += [(90, base[3]), (91, base[3].upper()), (92, base[3].replace(" ", "\n")), (93, base[3]), (93, base[3])]
    pairs += [(95, "ab" * 3000), (96, "ab" * 2000 + passage), (97, prose(7, 30000, 4000)), (98, "z" + "ab" * 100), (None, base[4]), (-5, base[5])]
    return pairs
