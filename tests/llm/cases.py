"""Small documents with everything that can be odd about a row."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: The columns of documents, then names that operators use inside.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[
            T.StructField(name, T.StringType())
            for name in ("id", "chunk", "bucket", "size", "node", "words", "held_out", "_id", "_row", "_text", "kind", "class_id")
        ],
    ]
)


def words(text):
    return WORD.findall(text or "")


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = []
    for r in rows:
        r = (*r, *[None] * (4 - len(r)))
        full.append((*r, None if r[1] is None else len(r[1]), *["x"] * 12))
    return spark.createDataFrame(full, SCHEMA)


def prose(n, seed, vocabulary=400):
    import random

    make = random.Random(seed)
    return " ".join(f"w{make.randrange(vocabulary)}" for _ in range(n))


ODD_TEXTS = [
    None,
    "",
    " \t\r\n\x0b\x0c ",
    "one",
    "a b  c",  # other white space belongs to words
    "Zażółć gęślą jaźń 漢字 😀😀",
    "\x00\x01\x1f end",
    "the the the the the the the the the the the the the the the the",
    " lead and trail \n",
    "line\nline\n\nline\r\nline",
]
