"""Small inputs that hold every awkward case, and plain versions to compare with."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    *[T.StructField(n, T.StringType()) for n in ("row", "name", "node", "key", "level", "kept", "score", "value", "raw", "_k", "digest", "group", "probability", "_source", "draw", "u", "all", "s", "_own", "_id", "_sha", "i", "h", "k", "g", "turn", "packed", "block", "names", "runs", "part")],
])

LONG = " ".join(f"word{i % 700} é{i % 13}." for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away"), (2, "The quick brown fox jumps over the lazy dog and runs away"),
    (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (7, "ONE"), (8, "123 456 !!! ..."), (9, "naïve café déjà vu — 日本語 don't"),
    (10, LONG), (11, LONG), (12, LONG + " tail"), (None, "a text without an id at all here"), (None, "a text without an id at all here"),
    (14, "same id other text one two three four"), (14, "another text under the same id"), (15, "repeated row of words"), (15, "repeated row of words"),
    (16, "ÉTÉ ÜBER <|endoftext|> it's 'tis"), (17, "x" * 5000),
]


def edge_docs(spark):
    rows = [(i, t, "en" if n % 3 else None, f"s{n % 2}" if n % 5 else None, None, *["junk"] * (len(SCHEMA) - 5)) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(ids_sets, percent):
    """Smallest id reachable, by comparing all pairs."""
    parent = {i: i for i, _ in ids_sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in ids_sets if i is not None and s]
    for n, (i, s) in enumerate(known):
        for j, t in known[:n]:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both) and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in parent}
