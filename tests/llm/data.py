"""Small documents with every edge case, and word makers."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, kept string, score string, predicted string, _row string, token string, rank string, _range string, component string"
EXTRA = ("x",) * 10


def words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


def edge_rows():
    base = words(60, 1)
    near = [*base[:30], "changed", *base[31:]]
    return [
        row(1, " ".join(base)),
        row(2, None, None, None),
        row(3, ""),
        row(4, " \n\t "),
        row(5, "12 34 !!"),
        row(6, " ".join(words(60_000, 2)), "en", "b"),
        row(7, " ".join(base).upper()),
        row(7, " ".join(base).upper()),
        row(8, "\n".join(near)),
        row(9, "één twee drie", "nl", None),
        row(10, "Un deux trois"),
        row(11, "un DEUX trois"),
        row(None, " ".join(base)),
        row(None, None),
        row(2**60 + 1, "big id"),
    ]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
