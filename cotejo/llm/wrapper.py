"""Main text of web pages by wrapper induction over the pages of a host.

Pages become trees of block elements; a run of like siblings without blocks inside (paragraphs,
list items) is one repeating node, like containers stay apart. Every page is aligned with the
reference page of its host, one for the whole table, by simple tree matching: the largest top-down
matching of two ordered trees, found by dynamic programming over the children of matched nodes.
There, a run of like containers counts as one child; inside it equal ones at either end meet,
the others meet in order. A place is a node of the reference tree, for nodes that met none it is
the path of labels. Counted over all pages of the host, copies once, a place where most pages have
one text is template, and a page's text there is left out if it is that text; places that are
mostly links are left out whatever they say.
Elements whose role is stated by tag, role or class name (menus, footers, adverts, forms,
comments ...) are never content, and where a page marks its article, content lies inside it.

Defined results: null reads as the empty page, whose text is empty; pages without a host share
one; copies of a page count once, so they do not turn it into template; a host with one page has no template. Malformed and cut-off markup is read as far as
it goes.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.session import stage

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template iframe object svg canvas math audio video head title nav footer aside form "
                  "button select option textarea input dialog menu map datalist fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class names and ids that say an element is not the article.
ASIDE = frozenset("""
ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation
topnav sidebar sidenav footer header masthead cookie cookies consent gdpr notice notices notification popup modal overlay
newsletter subscribe subscription signup login social share sharing related recommended recommendations breadcrumb
breadcrumbs comment comments commentlist disqus respond reply replies discussion pagination pager widget toolbar legal
copyright disclaimer search hidden
""".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
               "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot div section article main body blockquote td th li form nav aside header footer".split())
SPACE = re.compile(r"\s+")
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                    r"""|<(/?)(?:[A-Za-z])[^>]*>|<[!?][^>]*>""", re.S)
UNENDED = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
NAME = re.compile(r"[A-Za-z][a-z]*|\d+")


class Node:
    """A block element: its label, whether it is outside the article by its own statement, children."""

    __slots__ = ("sig", "tag", "aside", "marks", "children", "texts", "chars", "links")

    def __init__(self, sig: str, tag: str, aside: bool, marks: bool):
        self.sig, self.tag, self.aside, self.marks = sig, tag, aside, marks
        self.children: list[Node] = []
        self.texts: list[str] = []
        self.chars = self.links = 0


class Block:
    __slots__ = ("path", "text", "aside", "inside", "node")

    def __init__(self, path: str, text: str, aside: bool, inside: bool, node: Node):
        self.path, self.text, self.aside, self.inside, self.node = path, text, aside, inside, node


class Reader:
    """Builds the tree of block elements and the list of text blocks of a page."""

    def __init__(self, html: str):
        self.root = Node("", "", False, False)
        self.stack: list[tuple[str, Node]] = [("", self.root)]
        self.blocks: list[Block] = []
        self.buffer: list[str] = []
        self.link_chars = self.in_link = 0
        at, size = 0, len(html)
        while at < size:
            m = MARKUP.search(html, at)
            if m is None:
                rest = html[at:]
                self.data(UNENDED.sub("", rest))  # a tag that never ends is no text
                break
            if m.start() > at:
                self.data(html[at:m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, m[3])
            if tag in RAW:
                close = re.compile(f"</{tag}[^>]*>", re.I).search(html, at)
                at = close.start() if close else size
        self.flush()

    @property
    def node(self) -> Node:
        return self.stack[-1][1]

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.buffer)).strip()
        if text:
            path, aside, inside = [], False, False
            for _, n in self.stack[1:]:
                if path and path[-1] is n:
                    continue
                path.append(n)
                inside = inside or n.marks
                # a header inside the article heads the article
                aside = aside or (n.aside and not (n.tag == "header" and inside))
            self.blocks.append(Block(">".join(n.sig for n in path), text, aside, inside, self.node))
            self.node.texts.append(text)
            self.node.chars += len(text)
            self.node.links += min(self.link_chars, len(text))
        self.buffer, self.link_chars = [], 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "br":
                self.buffer.append(" ")
            elif tag not in VOID:
                self.in_link += tag == "a"
                self.stack.append((tag, self.node))
            return
        self.flush()
        if tag in VOID:
            return
        self.close_before(tag)
        a: dict[str, str] = {}
        if attributes:
            for name, value in ATTRIBUTE.findall(attributes):
                a.setdefault(name.lower(), unescape(value.strip("\"'")))
        names = " ".join((a.get("class") or "").split()[:4])
        words = {w.lower() for w in NAME.findall(f"{a.get('class', '')} {a.get('id', '')}")} if a else set()
        role = (a.get("role") or "").lower()
        aside = (tag in NEVER or tag == "header" or role in ROLES or bool(words & ASIDE) or "hidden" in a
                 or (a.get("aria-hidden") or "").lower() == "true") and tag not in ("html", "body")
        marks = tag == "article" or tag == "main" or role in ("main", "article") or a.get("itemprop") == "articleBody"
        child = Node(f"{tag}.{names}" if names else tag, tag, aside, marks and not aside)
        self.node.children.append(child)
        self.stack.append((tag, child))

    def close_before(self, tag: str) -> None:
        """Elements that a start tag ends without saying so."""
        for k in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[k][0]
            if open_tag in SAME_CLOSES.get(tag, ()) or open_tag == "p" or (open_tag == "head" and tag == "body"):
                self.pop_to(k)
                if tag not in ("tr", "tbody", "thead"):
                    return
            elif open_tag in HOLDERS:
                return

    def pop_to(self, k: int) -> None:
        self.in_link -= sum(t == "a" for t, _ in self.stack[k:])
        del self.stack[k:]

    def end(self, tag: str) -> None:
        if tag in VOID:
            return
        block = tag not in INLINE
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                if block:
                    self.flush()
                self.pop_to(k)
                return
            if not block and self.stack[k][0] not in INLINE:
                return  # an inline end tag never ends a block

    def data(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        self.buffer.append(text)
        if self.in_link:
            self.link_chars += len(text.strip())


def folded(node: Node, home: dict[int, tuple] | None = None) -> tuple[str, tuple, str, int, int]:
    """The node with runs of like leaves as one: label, children, text digest, characters, link characters.

    ``home`` receives, by identity, what each node below became.
    """
    children: list[list] = []
    for c in node.children:
        sig, below, text, chars, links = folded(c, home)
        if children and children[-1][0] == sig and not below and not children[-1][1]:
            last = children[-1]
            last[2], last[3], last[4] = last[2] + text, last[3] + chars, last[4] + links
            last[5].append(c)
        else:
            children.append([sig, below, text, chars, links, [c]])
    done = tuple((s, b, xxhash.xxh64_hexdigest(t) if t else "", c, k) for s, b, t, c, k, _ in children)
    if home is not None:
        for t, c in zip(done, children, strict=True):
            home.update((id(n), t) for n in c[5])
    return node.sig, done, "\x1f".join(node.texts), node.chars, node.links


def runs(children: tuple) -> list[tuple]:
    """Children by runs of one label."""
    out: list[list] = []
    for c in children:
        if out and out[-1][0][0] == c[0]:
            out[-1].append(c)
        else:
            out.append([c])
    return out


def match_runs(a: list[tuple], b: list[tuple]) -> tuple[int, list[tuple[tuple, tuple]]]:
    """Two runs of one label: equal members at the ends meet, then the others in order."""
    least, head, tail = min(len(a), len(b)), 0, 0
    while head < least and a[head] == b[head]:
        head += 1
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = [*zip(a[:least - tail], b[:least - tail], strict=True), *zip(a[len(a) - tail:], b[len(b) - tail:], strict=True)]
    size, pairs = 0, []
    for x, y in both:
        n, found = match(x, y)
        size += n
        pairs += found
    return size, pairs


def match(a: tuple, b: tuple) -> tuple[int, list[tuple[tuple, tuple]]]:
    """Simple tree matching: size of the largest matching of two ordered trees, and its pairs."""
    if a[0] != b[0]:
        return 0, []
    x, y = runs(a[1]), runs(b[1])
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    sub: dict[tuple[int, int], tuple[int, list]] = {}
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1])
            if x[i - 1][0][0] == y[j - 1][0][0]:
                sub[i, j] = match_runs(x[i - 1], y[j - 1])
                best[i][j] = max(best[i][j], best[i - 1][j - 1] + sub[i, j][0])
    pairs, i, j = [(a, b)], len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs += sub[i, j][1]
            i, j = i - 1, j - 1
    return best[-1][-1] + 1, pairs


def with_paths(tree: tuple, path: str = "") -> Iterator[tuple[str, tuple]]:
    for c in tree[1]:
        here = f"{path}>{c[0]}" if path else c[0]
        yield here, c
        yield from with_paths(c, here)


def packed(tree: tuple) -> bytes:
    """A tree as one JSON list of (depth, label, digest, characters, link characters) in page order."""
    out, todo = [], [(0, tree)]
    while todo:
        depth, n = todo.pop()
        out.append((depth, n[0], n[2], n[3], n[4]))
        todo += [(depth + 1, c) for c in reversed(n[1])]
    return zlib.compress(json.dumps(out).encode())


def unpacked(data: bytes) -> tuple:
    below: list[tuple] = []  # nodes that wait for their parent, the last one first
    for depth, sig, text, chars, links in reversed(json.loads(zlib.decompress(data))):
        children = []
        while below and below[-1][0] == depth + 1:
            children.append(below.pop()[1])
        below.append((depth, (sig, tuple(children), text, chars, links)))
    return below[0][1]


class References:
    """Reference trees and the numbers of their nodes by identity, the latest few kept unpacked."""

    def __init__(self, limit: int = 256):
        self.limit, self.known = limit, {}

    def __getitem__(self, data: bytes) -> tuple[tuple, dict[int, int]]:
        if data not in self.known:
            if len(self.known) >= self.limit:
                self.known.clear()
            tree = unpacked(data)
            self.known[data] = tree, {id(n): k for k, (_, n) in enumerate(with_paths(tree))}
        return self.known[data]


def placed(tree: tuple, reference: tuple[tuple, dict[int, int]] | None) -> Iterator[tuple[str, tuple, tuple | None]]:
    """Each node's place, the node, and the node of the reference it met."""
    met: dict[int, tuple] = {}
    if reference is not None:
        met = {id(other): mine for mine, other in match(reference[0], tree)[1]}
    for path, node in with_paths(tree):
        mine = met.get(id(node))
        yield path if mine is None else f"#{reference[1][id(mine)]}", node, mine


def reference_pages(pages: DataFrame) -> DataFrame:
    """One row per host: ``host`` and the ``tree`` of its reference page.

    The reference is the page of the smallest hash among those that are not blank, whatever the
    layout of the table; copies of it are one page.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [packed(folded(Reader(h.as_py()).root)) for h in batch.column("html")]
            yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "tree": pa.array(trees, pa.binary())})

    hashed = pages.where(F.trim("html") != "").select("host", "html", F.xxhash64("html").alias("hash"))
    least = hashed.groupBy(F.col("host").alias("of")).agg(F.min("hash").alias("least"))
    chosen = hashed.join(least, (F.col("host") == F.col("of")) & (F.col("hash") == F.col("least"))) \
        .groupBy("host").agg(F.min("html").alias("html"))
    return chosen.mapInArrow(read, "host string, tree binary")


def template_places(pages: DataFrame, constant: float = 0.5, linked: float = 0.8) -> DataFrame:
    """One row per host that has template places: ``host``, its reference ``tree`` and ``places``.

    ``place=digest`` names the constant text of a place, ``@place`` a place that is mostly links.
    """
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = References()
        for batch in batches:
            sums: dict[tuple[str, str, str, int], list[int]] = {}
            for host, html, data in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("tree"), strict=True):
                tree = folded(Reader(html.as_py()).root)
                found = [(place, node) for place, node, mine in placed(tree, references[data.as_py()] if data.is_valid else None)
                         if node[2] or (mine is not None and mine[2])]
                page = xxhash.xxh64_intdigest("\x1f".join(place + "=" + node[2] for place, node in found)) - (1 << 63)
                for place, node in found:
                    s = sums.setdefault((host, place, node[2], page), [0, 0])
                    s[0] += node[3]
                    s[1] += node[4]
            if sums:
                yield pa.RecordBatch.from_pydict({
                    **{n: [k[i] for k in sums] for i, n in enumerate(("host", "place", "digest"))},
                    **{n: pa.array(v, pa.int64()) for n, v in (("page", [k[3] for k in sums]), ("chars", [v[0] for v in sums.values()]),
                                                               ("links", [v[1] for v in sums.values()]))}})

    def both(*more):
        return [F.sum("chars").alias("chars"), F.sum("links").alias("links"), *more]

    trees = stage(reference_pages(pages))
    seen = pages.select("host", "html").join(trees, "host", "left") \
        .mapInArrow(align, "host string, place string, digest string, page long, chars long, links long")
    texts = seen.groupBy("host", "place", "digest", "page").agg(*both()) \
        .groupBy("host", "place", "digest").agg(*both(F.count("*").alias("n")))
    top = F.max(F.when(F.col("digest") != "", F.struct("n", "digest")))
    total = texts.groupBy("host", "place").agg(*both(F.sum("n").alias("all"), top.alias("top")))
    # the share among the other pages, so that two pages without a common text have none
    fixed = (F.col("all") > 1) & (F.col("top.n") - 1 >= constant * (F.col("all") - 1))
    linking = F.col("links") > linked * F.col("chars")
    name = F.when(linking, F.concat(F.lit("@"), "place")).otherwise(F.concat("place", F.lit("="), "top.digest"))
    places = total.where(fixed | linking).groupBy("host").agg(F.array_sort(F.collect_set(name)).alias("places"))
    return places.join(trees, "host", "left").select("host", "tree", "places")


def main_text(html: str, places: set[str], reference: tuple[tuple, dict[int, int]] | None = None) -> str:
    """The text of the page's varying places, blocks in page order.

    With a reference, ``places`` are those of ``template_places``; without, paths of labels.
    """
    reader = Reader(html)
    blocks = [b for b in reader.blocks if not b.aside]
    marked = [b for b in blocks if b.inside]
    if reference is None:
        return "\n\n".join(b.text for b in marked or blocks if b.path not in places)
    home: dict[int, tuple] = {}
    tree = folded(reader.root, home)
    out = {id(node) for place, node, _ in placed(tree, reference)
           if f"@{place}" in places or f"{place}={node[2]}" in places}
    return "\n\n".join(b.text for b in marked or blocks if id(home.get(id(b.node))) not in out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, main ``text`` and its length in characters, one row per page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")) \
        .withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))))
    places = stage(template_places(rows))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = References()
        for batch in batches:
            texts = [main_text(h.as_py(), set(p or ()), references[t.as_py()] if t.is_valid else None)
                     for h, p, t in zip(batch.column("html"), batch.column("places").to_pylist(), batch.column("tree"), strict=True)]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"),
                                              "text": pa.array(texts, pa.string()),
                                              "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return rows.join(places, "host", "left").select("page_id", "url", "html", "tree", "places") \
        .mapInArrow(extract, "page_id long, url string, text string, n_chars long")
