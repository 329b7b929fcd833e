"""Small literal tables with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "ou", "ti"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    texts = ["\n".join(words(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    texts[3] = texts[2]  # an exact copy
    texts[5] = texts[4].replace("th", "TH", 1)  # another case
    texts[7] = texts[6] + " extra"
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, "  \n\t ", "en", "a", 5), (n + 3, "only", "en", "a", 4), (n + 4, "word " * 3000, "en", "a", 15000), (n + 5, "x" * 5000, "en", "a", 5000)]
    rows += [rows[10], rows[10]]  # repeated rows
    rows += [(None, "no id " + texts[0], "en", "a", 1)]
    return rows


def frame(spark, rows=None):
    """The corpus with columns whose names clash with helpers."""
    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
    return df.selectExpr("*", "1 as _doc", "2 as n", "3 as word", "4 as label", "5 as key", "6 as _fp", "7 as component", "8 as u", "9 as _bad", "10 as _gone", "11 as score", "12 as spans", "13 as n_email", "14 as _id", "15 as _set", "16 as _h", "17 as _k", "18 as peak_weight")


def empty(spark):
    return frame(spark, [])
