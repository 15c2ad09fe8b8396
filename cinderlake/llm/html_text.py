"""Operator 9, HTML extraction: site template removal by subtree hashes counted per host, then block text.

1. Every element of a page gets a hash of its subtree (tag, class, id and role, text in collapsed white space, and the
   children's hashes). Boxes (blocks that are no prose) also get a hash of their skeleton: the same without text, equal
   neighbours counted once. Small subtrees (fewer than MIN_CHARS characters of text) are left to their parents.
2. A page's main block is the deepest box that holds MAIN_SHARE of its text outside links.
3. Spark counts, per host, the pages that hold each hash. It is template if it recurs on at least MIN_PAGES pages of the
   host; for each tenfold of pages beyond MIN_PAGES, MIN_PAGES more are asked for (25 of 50,000 pages), so what one section
   or language of a large host repeats is template there as on a small host of its own.
4. The page is read again without its templates: beside the main block, every element whose subtree or skeleton is template;
   inside it, boxes whose subtree is. Prose inside the main block stays: lines that articles of a host share are content.
5. Fallback, for hosts with few pages: elements that HTML itself marks as no main text (navigation, footers, asides, forms,
   scripts, ...) go, and those that name themselves so (all parts of a class, id or role name, such as menu, cookie-banner,
   comments). Names do not count for the article or main element that holds the page's text, and for nothing on the way to
   the main block where else no text would be left. If article or main elements hold at least half of the text that is left,
   only they count; else headers outside the main block go too.

Counting sends 16 bytes a hash. Templates are broadcast up to BROADCAST of them (16 MB), and pages then stay where they are;
beyond that pages travel to their template hashes as compressed bytes. Blocks: character references are decoded, white space
becomes one space, blocks are joined by line feeds.

Defined results: null html counts as empty, and pages without text give ''; a null or unparsable url is host ''.
Repeated rows are extracted each (and count as one page for recurrence if url and html are equal). An empty table
gives no rows. Extra columns are ignored. Elements may nest to any depth.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.llm.common import materialise, table

MIN_PAGES, MIN_CHARS, MAIN_SHARE = 5, 3, 0.75
BROADCAST = 1_000_000

#: HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
NO_TEXT = frozenset("head title script style noscript template iframe svg math object canvas audio video nav footer aside form button select option textarea input label fieldset dialog menu".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside caption".split())
#: Blocks that carry running text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption caption summary td th tr tbody address".split())
ROOTS = frozenset("#root html body".split())
#: A p ends where one of these begins.
ENDS_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot li dd dt caption figcaption summary".split())
#: Where an element of the first kind begins, an open one of the second kind ends, unless one of the third lies between.
ENDS_SELF = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "option": ("option", ("select",))}
#: Words in class, id or role that name parts which are no main text.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside complementary widget"
    " footer contentinfo masthead topbar toolbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login search searchbox dialog share sharing social"
    " comment comments commentlist replies reply respond disqus related recommended pagination pager skip copyright legal disclaimer".split()
)
#: Words that may stand beside them in one name.
BESIDE = frozenset("site page main top bottom left right header box bar list container wrapper inner outer section area block buttons links items content primary secondary global sub post entry article form slot unit wrap text message panel".split())
_MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?])")
_SPACE, _KEY, _EQUALS, _BARE = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "names", "children", "hidden", "digest", "shape", "size", "prose")

    def __init__(self, tag: str, names: str = "", hidden: bool = False):
        self.tag, self.names, self.hidden = tag, names, hidden
        self.children: list[Node | str] = []
        self.digest = self.shape = self.size = self.prose = 0


def attributes(page: str, at: int, last: dict[str, int]) -> tuple[list[tuple[str, str]], int, bool]:
    """Names and values from place at on, where the tag ends, and whether it closes itself. last: the last place of each quote;
    a quote that is never closed belongs to a bare value."""
    found = []
    while True:
        at = _SPACE.match(page, at).end()
        if at >= len(page):
            return found, at, False
        if page[at] == ">":
            return found, at + 1, page[at - 1] == "/"
        m = _KEY.match(page, at)
        key, value, at = m[0].lower(), "", m.end()
        if m := _EQUALS.match(page, at):
            at = m.end()
            quote = page[at : at + 1]
            if last.get(quote, -1) > at:
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                m = _BARE.match(page, at)
                value, at = m[0], m.end()
        found.append((key, value))


class Tree:
    """The elements that are open, with places of each tag's and of blocks, so that ending one costs what it closes."""

    def __init__(self):
        self.nodes = [Node("#root")]
        self.open, self.blocks, self.places = self.nodes[:], [], {}

    def push(self, node: Node) -> None:
        if node.tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def close(self, at: int) -> None:
        for node in reversed(self.open[at:]):
            self.places[node.tag].pop()
            if node.tag in BLOCKS:
                self.blocks.pop()
        del self.open[at:]

    def place(self, tag: str) -> int:
        held = self.places.get(tag)
        return held[-1] if held else 0

    def ends_before(self, tag: str) -> None:
        """Close what the start of an element of this kind ends."""
        if tag in ENDS_P and self.blocks and self.open[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        if tag in ENDS_SELF:
            own, stops = ENDS_SELF[tag]
            if self.place(own) > max(map(self.place, stops)):
                self.close(self.place(own))


def parse(page: str) -> list[Node]:
    """All elements in the order of their starts; the first is the root."""
    tree, at = Tree(), 0
    last = {q: page.rfind(q) for q in "\"'"}
    while True:
        m = _MARKUP.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            tree.open[-1].children.append(entities.unescape(text) if "&" in text else text)
        if not m:
            return tree.nodes
        at = m.end()
        if not m[2]:
            end = at if m[3] and page.startswith(">", at) else page.find("-->" if m[3] else ">", at)
            if end < 0:
                return tree.nodes
            at = end + (3 if m[3] and page.startswith("-->", end) else 1)
            continue
        tag = m[2].lower()
        given, alone = [], False
        if page[at : at + 1] == ">":
            at += 1
        else:
            given, at, alone = attributes(page, at, last)
        if m[1]:
            if place := tree.place(tag):
                tree.close(place)
            continue
        names = " ".join(v.lower() for k, v in given if k in ("class", "id", "role"))
        hidden = any(k == "hidden" or k == "aria-hidden" and v.lower() == "true" for k, v in given)
        tree.ends_before(tag)
        node = Node(tag, names, hidden)
        tree.open[-1].children.append(node)
        tree.nodes.append(node)
        if tag in VOID or alone and tag in RAW:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        else:
            tree.push(node)


def _hash(parts: list[str]) -> int:
    x = xxhash.xxh3_64_intdigest("".join(parts).encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def measure(nodes: list[Node]) -> None:
    """Sets digest, shape, size (characters of text) and prose (those outside links) of all nodes; children come after parents."""
    for node in reversed(nodes):
        parts, shape = [node.tag, "\x01", node.names], ["\x04", node.tag, "\x01", node.names]
        size = prose = 0
        for child in node.children:
            if isinstance(child, str):
                text = " ".join(child.split())
                if text:
                    parts += ["\x02", text]
                    size += len(text)
                    prose += len(text)
            else:
                parts.append(f"\x03{child.digest}")
                size += child.size
                prose += child.prose
                if shape[-1] != (own := f"\x03{child.shape}"):
                    shape.append(own)
        node.digest, node.shape, node.size = _hash(parts), _hash(shape), size
        node.prose = 0 if node.tag == "a" or node.tag in RAW else prose


def is_box(node: Node) -> bool:
    return node.tag in BLOCKS and node.tag not in PROSE and node.tag not in ROOTS


def main_path(root: Node) -> list[Node]:
    """The root, and box by box the way down to the main block."""
    path = [root]
    while root.prose:
        down = next((c for c in path[-1].children if isinstance(c, Node) and c.tag not in PROSE and c.prose >= MAIN_SHARE * root.prose), None)
        if down is None or down.tag not in BLOCKS and not any(isinstance(c, Node) and c.tag in BLOCKS for c in down.children):
            break
        path.append(down)
    return path


def subtree_digests(page: str) -> list[int]:
    """What may be template: subtrees and skeletons beside the main block, subtrees of boxes inside it."""
    nodes = parse(page)
    measure(nodes)
    path = main_path(nodes[0])
    on_path, found = set(map(id, path)), set()
    todo = [(nodes[0], False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node is path[-1] and node.tag not in ROOTS
        for child in node.children:
            if isinstance(child, str):
                continue
            if id(child) not in on_path and child.size >= MIN_CHARS and child.tag not in RAW and child.tag not in ("article", "main"):
                if is_box(child):
                    found.add(child.digest)
                    if not inside:
                        found.add(child.shape)
                elif not inside:
                    found.add(child.digest)
            todo.append((child, inside))
    return sorted(found)


def named_so(names: str) -> bool:
    for name in names.split():
        words = _WORD.findall(name)
        if words and not NAMES.isdisjoint(words) and all(w in NAMES or w in BESIDE for w in words):
            return True
    return False


def no_main_text(node: Node) -> bool:
    return node.tag in NO_TEXT or node.hidden or bool(node.names) and node.tag not in ("html", "body", "main") and named_so(node.names)


def left(nodes: list[Node], path: list[Node], template, spare: bool = False) -> set[int]:
    """ids of the elements that neither template rules nor the fallback takes away. Names do not count for the article or main
    element that holds the page's text, nor for what it lies in; with spare, for nothing on the way to the main block."""
    on_path, kept, todo = set(map(id, path)), {id(nodes[0])}, [(nodes[0], False)]
    down_to = len(path) if spare else max((k + 1 for k, n in enumerate(path) if n.tag in ("article", "main")), default=0)
    spared = set(map(id, path[:down_to]))
    while todo:
        node, inside = todo.pop()
        inside = inside or node is path[-1] and node.tag not in ROOTS
        for child in node.children:
            if isinstance(child, str) or no_main_text(child) and (id(child) not in spared or child.hidden or child.tag in NO_TEXT):
                continue
            if len(template) and id(child) not in on_path and child.tag not in ("article", "main"):
                if child.digest in template and (is_box(child) or not inside) or not inside and is_box(child) and child.shape in template:
                    continue
            kept.add(id(child))
            todo.append((child, inside))
    return kept


def mains_of(nodes: list[Node], kept: set[int]) -> list[Node]:
    """Outermost article elements (or main ones without) that are left, if they hold at least half of the text that is left."""
    mains, total = [], 0
    todo: list[tuple[Node, bool, bool]] = [(nodes[0], False, False)]
    held = {False: 0, True: 0}
    while todo:
        node, in_main, in_article = todo.pop()
        for child in reversed(node.children):
            if isinstance(child, str):
                n = len(child.strip())
                total += n
                held[in_article] += n * (in_main or in_article)
            elif id(child) in kept:
                article = child.tag == "article"
                main = not article and (child.tag == "main" or "main" in child.names.split())
                if not in_article and (article or main and not in_main):
                    mains.append(child)
                todo.append((child, in_main or main, in_article or article))
    articles = [m for m in mains if m.tag == "article"]
    if articles and 2 * held[True] >= total:
        own = set(map(id, articles))
    elif 2 * (held[True] + held[False]) >= total:
        own = {id(m) for m in mains if m.tag != "article"}
    else:
        own = set()
    return [m for m in nodes if id(m) in own]


def main_text(page: str, template=frozenset()) -> str:
    nodes = parse(page)
    measure(nodes)
    path = main_path(nodes[0])
    text = _text_of(nodes, path, left(nodes, path, template))
    return text if text or not nodes[0].prose else _text_of(nodes, path, left(nodes, path, template, True))


def _text_of(nodes: list[Node], path: list[Node], kept: set[int]) -> str:
    """Blocks of the elements that are kept. A header stays where it lies in the main block itself, among its prose."""
    mains = mains_of(nodes, kept)
    within, todo = set(), [path[-1]] if path[-1].tag not in ROOTS and any(isinstance(c, Node) and c.tag in PROSE for c in path[-1].children) else []
    while todo:
        node = todo.pop()
        within.add(id(node))
        todo.extend(c for c in node.children if isinstance(c, Node))
    blocks: list[list[str]] = [[]]
    for top in mains or nodes[:1]:
        blocks.append([])
        todo: list[Node | str | None] = [*reversed(top.children)]  # None: a border between blocks
        while todo:
            child = todo.pop()
            if child is None:
                blocks.append([])
            elif isinstance(child, str):
                blocks[-1].append(child)
            elif child.tag == "br":
                blocks[-1].append(" ")
            elif id(child) in kept and not (not mains and id(child) not in within and (child.tag == "header" or "header" in _WORD.findall(child.names))):
                if child.tag in BLOCKS:
                    blocks.append([])
                    todo.append(None)
                todo.extend(reversed(child.children))
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(rows: DataFrame, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """host, digest of what recurs; and row_a, row_b, host, digests of the pages. rows: row_a, row_b (hashes of url and html), host, html."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([subtree_digests(x) for x in part.column(3).to_pylist()], pa.list_(pa.int64()))], names=["row_a", "row_b", "host", "digests"])

    held = materialise(rows.mapInArrow(digests, "row_a bigint, row_b bigint, host bigint, digests array<bigint>").dropDuplicates(["row_a", "row_b"]), "subtrees")
    counts = held.select("host", F.explode("digests").alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    hosts = held.groupBy("host").agg(F.count("*").alias("host_pages"))
    recurs = counts.join(hosts, "host").where(F.col("n") >= min_pages * (1 + F.log10(F.col("host_pages") / min_pages)))
    return materialise(recurs.select("host", "digest"), "template"), held


class Templates:
    """The digests of each host, as sorted arrays."""

    def __init__(self, hosts: np.ndarray, digests: np.ndarray):
        by = np.argsort(hosts, kind="stable")
        self.hosts, self.digests = hosts[by], digests[by]

    def of(self, host: int) -> frozenset[int]:
        a, z = np.searchsorted(self.hosts, [host, host + 1]) if host < 2**63 - 1 else (np.searchsorted(self.hosts, host), len(self.hosts))
        return frozenset(self.digests[a:z].tolist())


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text of each row."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"row_a": F.xxhash64("url", "html"), "row_b": F.xxhash64("html", "url"), "host": F.xxhash64(host_of(F.col("url")))})
    template, held = templates(rows.select("row_a", "row_b", "host", "html"), min_pages)
    if template.count() <= BROADCAST:
        found = template.toArrow()
        shared = pages.sparkSession.sparkContext.broadcast(Templates(found.column("host").to_numpy(), found.column("digest").to_numpy()))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, frozenset[int]] = {}
            for batch in batches:
                if len(known) > 1000:
                    known.clear()
                for i in range(0, batch.num_rows, 500):
                    part = batch.slice(i, 500)
                    out = [main_text(x, known[h] if h in known else known.setdefault(h, shared.value.of(h))) for h, x in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

        return rows.select("page_id", "url", "host", "html").mapInArrow(near, "page_id bigint, url string, text string")
    marked = held.select("row_a", "row_b", "host", F.explode("digests").alias("digest")).join(template, ["host", "digest"]).groupBy("row_a", "row_b").agg(F.collect_set("digest").alias("template"))
    marked = materialise(marked, "marked")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6).compress
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                small = pa.array([pack(x) for x in part.column(4).cast(pa.binary()).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], small], names=["row_a", "row_b", "page_id", "url", "html"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                out = [main_text(unpack(h).decode("utf-8"), frozenset(t or ())) for h, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    sent = rows.select("row_a", "row_b", "page_id", "url", "html").mapInArrow(packed, "row_a bigint, row_b bigint, page_id bigint, url string, html binary")
    return sent.join(marked, ["row_a", "row_b"], "left").select("page_id", "url", "html", "template").mapInArrow(texts, "page_id bigint, url string, text string")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
