"""Awkward documents for every operator that reads texts."""

import random

_RND = random.Random(5)
_WORDS = ["".join(_RND.choices("abcdefghiklmnorstuv", k=_RND.randint(2, 9))) for _ in range(800)]


def prose(n: int, seed: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choices(_WORDS, k=n))


LONG = prose(30_000, 1)
COPY = prose(120, 2)
DOCS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, LONG), (7, COPY), (8, COPY), (9, COPY.upper()), (10, COPY + " tail"),
    (11, "x " * 400), (12, "A b.\nA b.\nA b.\n" + prose(60, 3)), (13, prose(80, 4) + "\n" + prose(10, 6)), (14, "é<|endoftext|>日本 ß ſ"), (15, prose(70, 7)), (15, prose(70, 7)),
]
SCHEMA = "doc_id long, text string"


def docs(spark, rows=DOCS, extra: bool = True):
    """With columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("source", F.when(F.col("doc_id") % 5 > 0, "s").cast("string"))
    if extra:
        d = d.withColumns({c: F.lit(i) for i, c in enumerate(["score", "host", "kept", "fp", "words", "h", "bin", "length", "ids", "file", "lang2", "n", "removed", "row"])})
    return d
