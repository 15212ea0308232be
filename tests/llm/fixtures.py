"""Small documents with the odd cases: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

import random

WORDS = "the of and to river stone under license token cat bird été für 水 x1 mit tree house walk".split()


def text(r, n):
    return "".join(r.choice(WORDS) + r.choice((" ", " ", " ", "  ", "\n", "\t")) for _ in range(n))


def documents(spark, seed=3, n=60):
    """As documents, and more columns that operators use as names of their own."""
    r = random.Random(seed)
    rows = [(i, text(r, r.randrange(0, 90)), "en", f"src{i % 3}", 0) for i in range(n)]
    rows += [(n + i, rows[i % 5][1], "en", "src9", 0) for i in range(12)]  # copies
    rows += [(n + 20, None, None, None, None), (n + 21, "", "en", "s", 0), (n + 22, " \n\t ", "en", "s", 0), (None, "no id here", "en", "s", 0), (None, None, "en", "s", 0)]
    rows += [(n + 23, "word " * 30_000, "en", "s", 0), (n + 24, "y" * 70_000, "en", "s", 0), (n + 25, "same row", "en", "s", 0), (n + 25, "same row", "en", "s", 0), (n + 25, "same id", "en", "s", 0)]
    extra = "labels string, key string, row long, text_ string, n_words long, slot int, fp long, kept boolean, h1 long"
    return spark.createDataFrame([(*x, "l", "k", 1, "t", 5, 2, 9, None, 4) for x in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
