import gzip
import hashlib
import io

import pytest

from cotejo.llm import templates, warc, wrapper

from .fixtures import odd_rows, table, words

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, PAGES).select("*", F.lit(1).alias("digest"), F.lit(2).alias("payload"), F.lit(3).alias("host"))


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_archive_comes_back(spark, split):
    big, other = "<p>" + "é" * 800 + "</p>", "x" * 1000
    rows = [(1, "http://a/1", big), (9, "http://a/9", big), (5, None, big), (2, "u\r\nX: y", "small"), (3, "", "small"), (4, "http://b", None),
            (6, "http://c", other), (7, "http://c", "x" * 999), (8, "http://c", "x" * 999), (None, "http://n", other), (6, "http://d", other)]
    got = warc.page_records(warc.read_warc(warc.write_warc(pages(spark, rows)), split)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    for r in got:
        texts = [h or "" for i, _, h in rows if i == r.page_id]
        data = texts[0].encode()
        first = max(i for i in groups[texts[0]] if i is not None) if len(groups[texts[0]]) > 1 else r.page_id
        revisit = len(data) >= 1000 and first != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))


def test_archives_are_plain_gzip(spark):
    files = warc.write_warc(pages(spark, [(k, "http://a", words(k, 200)) for k in range(5)])).collect()
    whole = b"".join(gzip.decompress(open(f.path.removeprefix("file:"), "rb").read()) for f in files)
    assert whole.count(b"WARC/1.0\r\n") == 5 and whole.count(b"WARC-Type: response") == 5


def test_magic_inside_a_payload_is_no_record():
    inner = warc.member(warc.record(77, "u", b"inner", "d", None, "t"))
    import zlib

    def stored(data):
        pack = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored blocks keep the bytes as they are
        return pack.compress(data) + pack.flush()

    junk = b"\x1f\x8b\x08" * 50
    data = b"".join([stored(warc.record(1, "u", junk, "d", None, "t")), warc.member(warc.record(2, "u", b"two", "d", None, "t")),
                     stored(warc.record(3, "u", junk, "d", None, "t")), warc.member(warc.record(4, "u", b"", "d", 2, "t"))])
    for split in (1, 7, 50, 400, len(data)):
        found = [f["warc-record-id"] for k in range(0, len(data), split)
                 for _, f, _ in warc.read_range(io.BytesIO(data), len(data), k, min(len(data), k + split))]
        assert found == [f"<urn:page:{k}>" for k in (1, 2, 3, 4)]
    assert inner.startswith(warc.MAGIC)


def test_no_pages(spark):
    assert warc.read_warc(warc.write_warc(pages(spark, []))).count() == 0
    assert wrapper.extract_pages(pages(spark, [])).count() == 0


def article(k, body):
    return (f"<html><head><title>t{k}</title><style>p{{}}</style></head><body><div class='top'>Daily News</div><nav><ul><li><a href='/a'>A{k}</a>"
            f"</li></ul></nav><div id=x><h2>Title {k}</h2><p>{body}</p><p>Fish &amp; <b>chips</b>&nbsp;&#233;\n  two<br>lines</div>"
            f"<div class='links'><a href=1>one{k}</a> <a href=2>two{k}</a></div><div class='Comments'><p>nice {k}</div>"
            f"<form><input value=q>go</form><script>var a='</p>';</script><div class=end>All rights</div></body></html>")


def test_constant_places_are_template(spark):
    rows = [(k, f"https://u@News.example:80/{k}", article(k, words(k, 12))) for k in range(6)]
    rows += [(50, "https://solo.example/", article(50, "solo")), (51, None, None), (None, "x", ""), (52, "https://cut.example/a", "<p>abc &am"),
             (53, "https://cut.example/b", "<article><p>in</p><p class='ad'>no</p><header><h1>head</h1></header></article><p>out <p cla")]
    got = {r.page_id: r for r in wrapper.extract_pages(pages(spark, rows)).collect()}
    for k in range(6):
        assert got[k].text == f"Title {k}\n\n{words(k, 12)}\n\nFish & chips é two lines"
        assert got[k].n_chars == len(got[k].text)
    assert got[50].text.startswith("Daily News\n\nTitle 50")  # nothing to align with
    assert got[51].text == got[None].text == ""
    assert got[52].text == "abc &am" and got[53].text == "in\n\nhead"


def test_copies_of_a_page_are_no_template(spark):
    rows = [(k, "http://same.example/", article(1, "all the same")) for k in range(4)]
    assert {r.text for r in wrapper.extract_pages(pages(spark, rows)).collect()} == {wrapper.main_text(article(1, "all the same"), {"html>body>div.links"})}


def test_repeated_containers_are_whole(spark):
    def note(k):
        return f"<div><p>{words(900 + k, 9) if k == 2 else 'Mind the gap'}</p></div>"

    rows = [(k, "http://bare.example/", f"<h1>T{k}</h1>{note(k)}<div><p>{words(k, 9)}</p></div>") for k in range(6)]
    rows += [(10 + k, "http://parts.example/", "<h1>T</h1><section><p>Read this first</p></section>"
              + "".join(f"<section><h2>H{k}</h2><p>{words(100 * k + j, 5)}</p></section>" for j in range(1 + k % 3))
              + "<section><p>All rights</p></section>") for k in range(6)]
    got = {r.page_id: r.text for r in wrapper.extract_pages(pages(spark, rows)).collect()}
    for k in range(6):  # a page's own text at a place that is template elsewhere stays
        assert got[k] == "\n\n".join([f"T{k}"] + [words(902, 9)] * (k == 2) + [words(k, 9)])
        assert got[10 + k] == "\n\n".join(x for j in range(1 + k % 3) for x in (f"H{k}", words(100 * k + j, 5)))


def test_one_page_a_batch_is_aligned(spark):
    rows = [(k, "http://far.example/", f"<h1>T{k}</h1><section>same on all pages</section><p>{words(k, 9)}</p>") for k in range(8)]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        got = wrapper.extract_pages(pages(spark, rows).repartition(8, "page_id")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert {r.page_id: r.text for r in got} == {k: f"T{k}\n\n{words(k, 9)}" for k in range(8)}


def test_trees_come_back():
    tree = wrapper.folded(wrapper.Reader(article(1, "é text")).root)
    assert wrapper.unpacked(wrapper.packed(tree)) == tree


def test_tree_matching():
    def t(label, *children):
        return (label, tuple(children), label, 1, 0)

    a = t("r", t("a", t("b"), t("c")), t("d"), t("e"))
    b = t("r", t("x"), t("a", t("c")), t("e"))
    size, pairs = wrapper.match(a, b)
    assert size == len(pairs) == 4 and all(x[0] == y[0] for x, y in pairs)
    assert wrapper.match(t("a"), t("b")) == (0, [])


ITEM = ("Yesterday Tom Smith bought 3 kg of fresh apples and later Tom Smith gave 5 kg away to poor people in Paris today")
BENCH = [(1, ITEM), (2, "four words are here"), (3, "too short"), (4, None), (None, words(5, 30)), (5, words(6, 40)), (6, words(6, 40))]


def benchmark(spark):
    return spark.createDataFrame([(i, t, 0) for i, t in BENCH], "item_id long, text string, pos int")


def test_templates(spark):
    changed = "Well. Yesterday Anna bought 7 kg of fresh apples and later Anna gave 9 kg away to poor people in Rome today indeed."
    rows = odd_rows() + [
        (100, "Intro. " + ITEM + ". Outro."), (101, changed), (102, changed.replace("later Anna", "later Bob")),
        (103, changed.replace("9 kg", "7 kg")), (104, "see four words are here now"), (105, "too short"), (106, words(5, 30)),
        (107, words(77, 500) + "\n" + words(6, 40) + "\n" + words(78, 500)), (108, words(6, 40)[:60]), (108, words(6, 40)), (109, ITEM[:40])]
    got = sorted(tuple(r)[:2] + (r.reparameterised,) for r in templates.contaminated(table(spark, rows, clash=True), benchmark(spark)).collect())
    assert got == [(100, 1, False), (101, 1, True), (104, 2, False), (107, 5, False), (107, 6, False), (108, 5, False), (108, 6, False)]
    kept = templates.without_leaks(table(spark, rows, clash=True), benchmark(spark))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in (100, 101, 104, 107, 108))
    assert kept.columns == table(spark, rows, clash=True).columns


LONG = ("Each morning the old baker of our town puts 3 loaves on the long table and waits for the children who live near the river, "
        "and in the evening the same baker takes 5 loaves home because nobody came to eat them after the storm had closed the road")


def consistent_windows(item: str, doc: str) -> tuple[int, int]:
    """Windows of the item at one diagonal left by a scan of its slots in reading order, and all of them."""
    t, d = (templates.Canonical().templates([x]) for x in (item, doc))
    assert (t.hashes == d.hashes).all()
    there, back, bad = {}, {}, set()
    for k in range(len(t.at)):
        if t.kinds[k] != templates.WORD:
            a, b = (templates.slots(x.kinds, x.raw, x.at, k, 1)[0] for x in (t, d))
            if there.setdefault(a, b) != b or back.setdefault(b, a) != a:
                bad.add(k)
    starts = range(len(t.at) - templates.WINDOW + 1)
    return sum(not bad & set(range(s, s + templates.WINDOW)) for s in starts), len(starts)


def test_a_clash_costs_only_its_windows(spark):
    twice = LONG.replace("5 loaves", "3 loaves")
    items = spark.createDataFrame([(1, LONG), (2, twice)], "item_id long, text string")
    rows = [(1, LONG.replace("3 loaves", "4 loaves").replace("5 loaves", "4 loaves")),  # two values of the item become one
            (2, LONG.replace("3 loaves", "7 loaves").replace("5 loaves", "9 loaves")),  # clash with item 2, whose value is torn
            (3, LONG), (4, twice)]
    got = {(r.doc_id, r.item_id): (r.windows, r.item_windows, r.reparameterised)
           for r in templates.contaminated(table(spark, rows), items).collect()}
    texts, wanted = dict(rows), {1: LONG, 2: twice}
    for pair in [(d, i) for d in texts for i in wanted]:
        assert got[pair][:2] == consistent_windows(wanted[pair[1]], texts[pair[0]])
    assert got[1, 1][0] < got[1, 1][1] and got[2, 1][0] == got[2, 1][1] and got[2, 2][0] < got[2, 2][1]
    assert [got[p][2] for p in [(1, 1), (2, 1), (3, 1), (4, 2)]] == [True, True, False, False]


def test_templates_of_no_rows(spark):
    assert templates.contaminated(table(spark, []), benchmark(spark)).count() == 0
    assert templates.contaminated(table(spark, odd_rows()), benchmark(spark).limit(0)).count() == 0


def test_filter_never_loses_a_window(spark):
    import numpy as np

    items = templates.stage(templates.template_windows(
        spark.createDataFrame([(k, words(k, 60)) for k in range(30)], "id long, text string"), None, 8, 4, None))
    bits = np.frombuffer(templates.window_filter(items, words=64), "<u8")
    found = np.array([r.hash for r in items.collect()], np.int64).view(np.uint64)
    assert templates.passes(bits, found).all()
    wide = np.frombuffer(templates.window_filter(items), "<u8")
    assert templates.passes(wide, np.arange(1, 20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.01
