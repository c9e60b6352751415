"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated
rows, and extra columns named like the operators' own."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, rank string, size string, cid string, key string"
BASE = ["doc_id", "text", "lang", "source", "n_chars"]
EXTRA = ("k", "r", "s", "c", "y")


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "to", "in", "that", "is", *[f"{a}{b}{c}" for a in ("ba", "ko", "mi") for b in ("ra", "len") for c in ("tor", "ve", "sun")]]
    return " ".join(rng.choice(vocab) for _ in range(n))


def near_copy(text: str, changes: int, seed: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def rows():
    a, b = prose(120, 1), prose(90, 2)
    long = "\n".join(prose(2000, k) for k in range(20))
    out = [(1, a, "en", "s1"), (2, a.upper(), "en", "s1"), (3, near_copy(a, 2, 5), "en", "s2"), (4, near_copy(a, 3, 6), "en", None),
           (5, b, "de", "s2"), (6, b + " ", "de", "s2"), (7, None, None, None), (8, "", "fr", "s3"), (9, "  \n\t ", "fr", "s3"),
           (10, "one", "fr", "s3"), (11, "one two three", "es", "s3"), (12, "One two\tthree", "es", "s3"), (13, long, "en", "s1"),
           (14, long + " end", "en", "s1"), (None, b, None, "s4"), (None, prose(50, 9), "en", "s4"), (16, "Ärger über Öl ß", "de", "S1"),
           (17, "x" * 5000, "en", "s5"), (18, "# * | <> " * 40, "en", "s5"), (19, "same line\n" * 30, "en", "s5"),
           (20, a.replace(" the", " the "), "en", "s1")]
    out += [(30, prose(70, 30), "en", "s2")] * 3  # repeated rows
    out += [(40 + k, prose(30, 400 + k), "en", "hot") for k in range(200)]  # a hot source, ties in size
    out += [(300 + k, near_copy(a, 1, 700 + k), "en", "hot") for k in range(40)]
    return [(d, t, l, s, None if t is None else len(t), *EXTRA) for d, t, l, s in out]


def frame(spark, some=None, parts: int = 3):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(parts)
