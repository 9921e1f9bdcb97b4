"""Rows with every awkward case, and brute-force references."""

import random

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SF = "/root/testdata/sf0.001"
_RNG = random.Random(0)
LONG = " ".join(_RNG.choice(("alpha", "beta", "gamma", "the", "of")) + str(k % 977) for k in range(30_000))
TEXTS = [None, "", " \t\n", "one", "Two words", "the of and", LONG, LONG, "a b c d e", "A b C d e", "é ß Σας ΟΔΟΣ İ \u1c89", "x" * 5000,
         "line\nline\nline\n\n\nother\n", "<|endoftext|> stop <|startoftext|>", "tab\x0bfeed\x0csep\x1cnext\u00a0end"]
DOCS = [(k if k % 6 else None, t, ("en", None, "fr")[k % 3], "src", 1, "clash", 0.5) for k, t in enumerate(TEXTS)] + [(3, "one", "en", "src", 1, "clash", 0.5)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {} string, {} double"


def docs(spark, a="found", b="score", rows=None):
    """Awkward documents with two extra columns whose names may clash."""
    return spark.createDataFrame(DOCS if rows is None else rows, SCHEMA.format(a, b))


def words(text):
    return (text or "").encode().translate(LOWER).split()


def rows(df):
    return [tuple(r) for r in df.collect()]
