"""Small tables, plain readings of the rules, and the awkward rows every operator must take."""

from __future__ import annotations

import os
import re
import sys
import zlib
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

LONG = " ".join(f"w{i % 9973}" for i in range(60_000))

#: Nulls, empty and blank texts, repeated rows, one id with two texts, a very long text.
AWKWARD = [
    (1, "The cat sat on the mat and the dog slept by the old door", "en", "a"),
    (1, "The cat sat on the mat and the dog slept by the old door", "en", "a"),
    (1, "another text under the same id with quite a few other words here", "en", "b"),
    (None, "a text without an id that has some words in it for the test", None, None),
    (None, None, None, None), (3, None, "en", "a"), (4, "", "en", "a"), (5, " \n\t \n", "de", "b"),
    (6, LONG, "en", "c"), (7, "Ünïcode, naïve 😀 text\nsecond line\n\nlast", "fr", ""), (8, "one", "en", "a"),
]
CLASH = ("n_words", "size", "key", "_t", "_h", "_row", "score", "deleted", "text_hash", "_u", "label", "id")


def documents(spark, rows=AWKWARD, extra=CLASH):
    """A table of documents with columns whose names operators use themselves."""
    schema = "doc_id bigint, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    return df.select("*", F.length("text").cast("bigint").alias("n_chars"),
                     *[F.lit(f"x{i}").alias(x) for i, x in enumerate(extra)])


def labels(spark, rows=((1, 0, 0), (6, 1, 1), (7, 1, 0), (None, 1, 1), (8, None, None), (1, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def real(table, sf=SF):
    import duckdb

    return duckdb.sql(f"select * from '{sf}/{table}.parquet'").fetchall()


def crc(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, fold=lower):
    w = WORD.findall(fold(text))
    if len(w) < 5:
        return [tuple(w)] if w else []
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def jaccard_components(docs):
    """{id: (set size, smallest linked id)} by comparing all documents that share a shingle."""
    sets = {k: set(shingles(t)) for k, t in docs}
    holders, up = defaultdict(list), {k: k for k in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, v in sets.items():
        for x in v:
            holders[x].append(k)
    for k, v in sets.items():
        for j, n in Counter(j for x in v for j in holders[x] if j > k).items():
            if 100 * n >= 75 * (len(v) + len(sets[j]) - n):
                a, b = top(k), top(j)
                up[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), top(k)) for k in sets}
