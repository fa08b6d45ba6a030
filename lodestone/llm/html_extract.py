"""Main text of HTML pages, with the site's template removed.

A page becomes a tree of elements.  The hash of each subtree that may belong to
a template is counted per host in Spark, over pages with different main text;
subtrees that recur across many pages of their host are deleted.  What is left
of the article, or of the page without one, is written block by block.

Elements that lie deeper than ``DEPTH`` are not nested any further: their text
belongs to the element at that depth, block by block.  As in HTML parsers, a
``<`` before a letter begins a tag, so ``a<b`` hides what follows up to ``>``.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import broadcast_if_small, materialize
from lodestone.llm._tokens import lean

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_NOT_P = tuple(BLOCK - {"p"})
#: A start tag of the key ends an open element of the values, up to the nearest element that holds both.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe svg math object canvas audio video dialog menu title noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar".split())
#: A class or id with one of these words marks what isn't the article.
_NAME = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
DROPPED_WORDS = re.compile(r"(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|comments?|commentlist|replies|respond|disqus|widget|pagination|pager|skip)", re.IGNORECASE)
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr table tbody ul ol dl dt dd figure figcaption b i em strong a span br code".split())

#: Words that may stand beside those in a name; a name with any other word ("social-science") says nothing.
COMPANIONS = re.compile(r"(?:[a-z]?\d*|area|article|bar|block|body|bottom|box(?:es)?|btn|buttons?|center|col(?:umn)?|container|content|footer|form|global|google|header|holder|icons?|inline|inner|item|items|label|large|left|links?|list|main|mobile|outer|page|panel|placeholder|policy|post|posts|primary|right|row|rail|section|sections|site|slot|small|sticky|stories|text|title|tool|tools|top|unit|us|user|wide|wrap|wrapper|you|your|media|email|mail|letter|list|bottom|secondary|sub|reader|readers|id|div|module|to|more|also|read|thread|feed|message|messages|info|alert)", re.IGNORECASE)
#: A subtree is a template's if it is on this many pages of a host, and on the square root of their number.
MIN_PAGES = 5
DEPTH = 400


class Node:
    __slots__ = ("attrs", "children", "digest", "says", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.digest, self.says = tag, attrs, [], 0, False


def parse(page: str) -> Node:
    """The tree of a page; unclosed and misnested tags are closed by the tags around them."""
    root = Node("#root", {})
    stack, at = [root], 0
    deeper: list[str] = []  # open elements below DEPTH
    count: Counter[str] = Counter()

    def close(names: tuple[str, ...], bars: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in bars:
                return

    while m := _TAG.search(page, at):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1] and count[tag]:
            while True:
                count[last := deeper.pop()] -= 1
                if last == tag:
                    break
            if tag in BLOCK:
                stack[-1].children.append(Node(tag, {}))
            continue
        if m[1]:
            deeper.clear(), count.clear()
            bars = ("article", "main", "body") if tag not in ("article", "main", "body", "html") else ()
            close((tag,), bars)
            continue
        if tag in BLOCK and not deeper:
            close(("p",), _NOT_P)
        if tag in CLOSES and not deeper:
            close(CLOSES[tag], HOLDS[tag])
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            if len(stack) <= DEPTH:
                stack.append(node)
            else:
                deeper.append(tag)
                count[tag] += 1
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def boilerplate(node: Node, inside: bool) -> bool:
    """Whether tag, role, class, id or visibility say that an element isn't the article; ``inside``: it is in an article."""
    if node.tag in DROPPED:
        return True
    if node.tag == "header" and not inside:
        return True
    if not node.attrs:
        return False
    a = node.attrs
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if a.get("role", "").lower() in DROPPED_ROLES:
        return True
    if node.tag in ("html", "body", "main") or (node.tag == "article" and not inside):
        return False
    return any(_says_so(name, inside) for name in [*a.get("class", "").split(), a.get("id", "")])


def _says_so(name: str, inside: bool) -> bool:
    """Whether a class or id consists of words of what isn't the article and of their companions."""
    found = [x for x in _NAME.split(name) if x]
    said = [bool(DROPPED_WORDS.fullmatch(x)) or (x.lower() == "header" and not inside) for x in found]
    return any(said) and all(y or COMPANIONS.fullmatch(x) for x, y in zip(found, said, strict=True))


def _pruned(node: Node, inside: bool) -> Node:
    """The tree without boilerplate, each node with its digest and whether it says anything."""
    out = Node(node.tag, node.attrs)
    digest = hashlib.blake2b(f"<{node.tag} {node.attrs.get('class', '')}>".encode("utf-8", "surrogatepass"), digest_size=8)
    for child in node.children:
        if isinstance(child, str):
            words = " ".join(html.unescape(child).split())
            out.says |= bool(words)
            digest.update(words.encode("utf-8", "surrogatepass"))
            out.children.append(child)
        elif not boilerplate(child, inside):
            deeper = _pruned(child, inside or child.tag in ("article", "main"))
            out.says |= deeper.says
            digest.update(deeper.digest.to_bytes(8, "little", signed=True) + b">")
            out.children.append(deeper)
    out.digest = int.from_bytes(digest.digest(), "little", signed=True)
    return out


def _without(node: Node, inside: bool, gone: frozenset[int]) -> Node:
    """The tree without the subtrees whose digest is in ``gone``."""
    out = Node(node.tag, node.attrs)
    for c in node.children:
        if isinstance(c, str):
            out.children.append(c)
        elif c.digest not in gone or not eligible(c, inside):
            out.children.append(_without(c, inside or c.tag in ("article", "main"), gone))
    return out


def eligible(node: Node, inside: bool) -> bool:
    """Whether a subtree may belong to a template: within an article, plain text elements without attributes may not."""
    return node.tag not in ("html", "body", "article", "main") and not (inside and node.tag in _PLAIN and not node.attrs)


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, white space as one blank, without empty ones."""
    out, run = [], []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    def walk(x: Node) -> None:
        for c in x.children:
            if isinstance(c, str):
                run.append(c)
            elif c.tag in BLOCK:
                flush()
                walk(c)
                flush()
            else:
                run.append(" ") if c.tag == "br" else walk(c)

    walk(node)
    flush()
    return out


def main_node(tree: Node) -> Node:
    """The article with the most text; without one the main element, else the whole tree."""

    def find(node: Node, want) -> Iterator[Node]:
        for c in node.children:
            if isinstance(c, Node):
                if want(c):
                    yield c
                else:
                    yield from find(c, want)

    for want in (lambda x: x.tag == "article" or x.attrs.get("role") == "article", lambda x: x.tag == "main" or x.attrs.get("role") == "main"):
        found = list(find(tree, want))
        if found:
            best = max(found, key=lambda x: sum(map(len, blocks(x))))
            if blocks(best):
                return best
    return tree


def extract(page: str, gone: frozenset[int] | None = None) -> str:
    tree = _pruned(parse(page), False)
    return "\n".join(blocks(main_node(_without(tree, False, gone) if gone else tree)))


def template_hashes(page: str) -> tuple[set[int], int]:
    """(digests of the subtrees that may belong to a template, hash of the main text)."""
    tree = _pruned(parse(page), False)
    out: set[int] = set()

    def walk(node: Node, inside: bool) -> None:
        for c in node.children:
            if isinstance(c, Node):
                if c.says and eligible(c, inside):
                    out.add(c.digest)
                walk(c, inside or c.tag in ("article", "main"))

    walk(tree, False)
    text = "\n".join(blocks(main_node(tree)))
    return out, int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, page, gone array<long>): of each page, told apart by host and MD5 of its html, the digests of its template subtrees.

    A subtree is a template's if it is on ``min_pages`` pages of its host or
    more, and on the square root of their number or more.  Pages of a host
    with the same main text count as one, so that copies of an article aren't
    taken for a template.  Digests meet their counts page by page, so no row
    grows with its host.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            host, page, h, text = [], [], [], []
            for url, sign, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                hashes, main = template_hashes(source.as_py() or "")
                of = host_of(url)
                for x in (None, *hashes):
                    host.append(of), page.append(sign), h.append(x), text.append(main)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.string()), pa.array(h, pa.int64()), pa.array(text, pa.int64())], names=["host", "page", "h", "text"])

    source = F.col(html_col).cast("string")
    seen = materialize(pages.select(F.col(url_col).cast("string"), F.md5(source), source).mapInArrow(run, "host string, page string, h long, text long"), "subtrees")
    counts = materialize(seen.select("host", "h", "text").distinct().groupBy("host", "h").agg(F.count("*").alias("n")), "counts")
    total = counts.filter("h is null").select(F.col("host").alias("of"), F.col("n").alias("pages"))
    often = counts.filter((F.col("n") >= min_pages) & F.col("h").isNotNull())
    often = often.join(total, F.col("host") == F.col("of")).filter(F.col("n") * F.col("n") >= F.col("pages")).select("host", "h")
    return seen.join(broadcast_if_small(materialize(often, "often")), ["host", "h"]).groupBy("host", "page").agg(F.sort_array(F.collect_set("h")).alias("gone"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **limits) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null page has no text; a page without a host, or a null url, belongs to
    the host "".  Rows that repeat a page are pages of their own.  Other
    columns are not read.
    """
    templates = broadcast_if_small(materialize(site_templates(pages, url_col=url_col, html_col=html_col, **limits), "templates"))

    @F.arrow_udf("string")
    def host(urls: pa.Array) -> pa.Array:
        return pa.array(map(host_of, urls.to_pylist()), pa.string())

    @F.arrow_udf("string")
    def text(source: pa.Array, gone: pa.Array) -> pa.Array:
        lean()
        return pa.array((extract(p.as_py() or "", frozenset(g.as_py() or ())) for p, g in zip(source, gone, strict=True)), pa.string())

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("at", host(F.col("url").cast("string"))).join(templates, (F.col("at") == F.col("host")) & (F.md5("html") == F.col("page")), "left")
    return rows.select("page_id", "url", text("html", "gone").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
