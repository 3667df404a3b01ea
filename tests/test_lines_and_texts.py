"""Lines equal a look-back over the open lines; texts of any length are joined in order."""

import random
import re

from pyspark.sql import functions as F

from cotejo.operators import layout as ly
from cotejo.operators.scan import ordered_texts

WORDS = "doc_id long, page long, pos long, text string, x0 double, x1 double, top double, bottom double"


def plain_lines(words, tol=2.5, back=3):
    """Lines of one page, each a sorted list of positions, in order."""
    open_ = []
    for top, x0, pos, bottom in sorted((w[6], w[4], w[2], w[7]) for w in words):
        centre = (top + bottom) / 2
        for line in reversed(open_[-back:]):
            if line["top"] - tol <= centre <= line["bottom"] + tol:
                break
        else:
            line = {"top": top, "bottom": bottom, "words": []}
            open_.append(line)
        line["words"].append((x0, pos))
        line["top"], line["bottom"] = min(line["top"], top), max(line["bottom"], bottom)
    open_.sort(key=lambda v: (v["top"], min(v["words"])[0]))
    return [sorted(p for _, p in v["words"]) for v in open_]


def read(spark, words):
    found = {}
    for r in ly.lines(spark.createDataFrame(words, WORDS)).collect():
        found.setdefault(r.page, {}).setdefault(r.line, []).append(r.pos)
    return {p: [sorted(v[k]) for k in sorted(v)] for p, v in found.items()}


def test_tall_cell_beside_short_lines(spark):
    """A cell over three printed lines holds them together, before, between and after short lines."""
    tall = (1, 1, 0, "TOTAL", 10.0, 40.0, 14.0, 54.0)
    short = [(1, 1, 1 + k, f"w{k}", 60.0, 90.0, 13.0 * (k // 2), 8.0 + 13.0 * (k // 2)) for k in range(14)]
    words = [tall, *short, (1, 1, 20, "ALTO", 10.0, 40.0, 70.0, 130.0), (1, 1, 21, "fin", 10.0, 30.0, 140.0, 148.0)]
    want = plain_lines(words)
    assert len(want) > 3
    assert read(spark, words) == {1: want}


def test_lines_equal_the_fold_on_random_pages(spark):
    rnd = random.Random(4)
    words = []
    for page in range(40):
        for pos in range(rnd.randint(1, 40)):
            top = rnd.choice([10.0 * rnd.randint(0, 12), rnd.uniform(0, 120)])
            words.append((1, page, pos, "x", float(rnd.randint(0, 500)), 510.0, top, top + rnd.choice([8.0, 8.0, 8.0, 3.0, 35.0])))
    got = read(spark, words)
    for page in range(40):
        assert got[page] == plain_lines([w for w in words if w[1] == page])


def test_a_million_continuation_lines_after_one_row(spark):
    n = 1_000_000
    pieces = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(7).alias("isla"), ((F.col("id") * 7919) % n).alias("seq")).select(
        "*", F.concat(F.lit("t"), F.col("seq").cast("string")).alias("t"))
    joined = ordered_texts(pieces, ["doc_id", "isla"], "seq", {"texto": F.col("t")})
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) >= 3
    (row,) = joined.collect()
    parts = row.texto.split(" ")
    assert len(parts) == n and parts[0] == "t0" and parts[-1] == f"t{n - 1}" and parts[123_456] == "t123456"


def test_texts_keep_order_over_pages_and_leave_out_nulls(spark):
    rows = [(1, (p << 32) + line, f"{p}.{line}" if (p + line) % 3 else None, "") for p in (0, 1, 300, 70_000) for line in (0, 1, 5_000)]
    rows += [(2, 5, None, "only")]
    random.Random(1).shuffle(rows)
    got = {r.k: r for r in ordered_texts(spark.createDataFrame(rows, "k int, o long, a string, b string"), ["k"], "o",
                                         {"a": F.col("a"), "b": F.nullif("b", F.lit(""))}, {"a": "|", "b": " "}).collect()}
    assert got[1].a == "|".join(t for _, _, t, _ in sorted((r for r in rows if r[0] == 1 and r[2]), key=lambda r: r[1])) and got[1].b is None
    assert got[2].a is None and got[2].b == "only"
