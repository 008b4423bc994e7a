"""Small tables with all that operators must cope with."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = ["size", "target", "taken", "score", "predicted", "row", "root", "kept", "rank", "key", "length", "part", "_doc", "ids"]


def words(seed, n, letters="abcdefghij"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(n))


def hard_rows():
    """Nulls in every column, empty, blank and very long texts, signs of all kinds, repeated and tied rows."""
    long = words(5, 60_000)
    texts = ["", None, " \n\t ", "One", "two WORDS", "É à la 日本語 don't 'scot", "x\x1cy z", "<|endoftext|> a<|endoftext|>b", "a" * 5000, long, words(1, 300), words(2, 2500)]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(3, "One", "en", "src0", 3)] * 3 + [(7, "another text of the same id", None, None, None)]
    rows += [(None, words(1, 300), None, None, None), (None, None, None, None, None), (-5, words(1, 300) + " more", "de", "", 7)]
    return rows


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """The frame with a column of each clashing name."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def twins(power):
    """Two words of 2 ** power letters whose sums of powers are equal modulo 2 ** 64 for every odd factor."""
    a = "a"
    for _ in range(power):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))
