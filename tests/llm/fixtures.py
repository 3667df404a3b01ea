"""Small tables shared by the tests of the text operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for their own columns.
CLASHING = ["key", "node", "bucket", "bands", "score", "piece_ids", "decoded", "terms", "_kept", "_leaked", "place", "words"]


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    rnd = random.Random(seed)
    out = [f"w{rnd.randrange(vocabulary)}x" for _ in range(n)]
    return " ".join(w + ("." if rnd.random() < 0.1 else "") for w in out)


def table(spark, rows, clash: bool = False):
    """A documents table of (id, text) pairs, with columns of clashing names if asked."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], DOCS)
    if clash:
        df = df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))
    return df


def odd_rows():
    """Null and empty texts, null ids, repeated ids and texts, a long text."""
    long = words(1, 6000)
    return [(1, None), (2, ""), (3, "   \n "), (4, "one"), (5, "one"), (5, "one"), (None, "no id here"), (6, long), (7, long),
            (8, "é漢字 🙂 \u0000 tab\there"), (9, words(2, 80)), (10, words(3, 90)), (11, "a  b   c\n\n d ")]
