"""HTML extraction by tag-path ratios.

A page is read into text leaves, each with its root-to-leaf tag path. Per path the text length and the punctuation of all
its leaves are summed and divided by their number; both ratios are smoothed over neighbouring leaves and fused, and paths
above a share of the scores' deviation are content. Tags, roles, classes and ids that tell of menus, headers, footers,
sidebars, notices, adverts, forms or comments are hints: they mark the path and scale its score down, once for each marked
element, so a hint that holds for all of a page (a form or class around everything) changes nothing. Links scale likewise.
The container is found by descending from the root while one element holds most of the content paths' text; where it lies
in an article or main element, that is taken whole. Of the container, blocks of content paths stay, and with them headings,
paragraphs, items and cells that no hint below the container marks, but for items that are links.

Defined cases: null and empty html give an empty text; text without tags is content as it is; unclosed and stray tags are
closed or ignored as browsers do; a cut-off tag or reference at the end is dropped or kept as text; repeated rows give
repeated rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?:svg|math)(?=[\s/>])[^>]*/>"
    r"|<(?P<raw>script|style|noscript|iframe|textarea|title)(?=[\s/>])[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<drawn>svg|math)(?=[\s/>])[^>]*>(?:(?!<(?:p|div|h[1-6]|[uod]l|li|d[dt]|table|pre|blockquote|article|section|main|body)[\s/>]).)*?</(?P=drawn)\s*>"
    r"|<(?P<held>template|select|object|canvas)(?=[\s/>])[^>]*>.*?</(?P=held)\s*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\bhidden\b")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("td th tr tbody thead tfoot body html head li dd dt".split())
_SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}
_AWAY_TAG = frozenset("nav footer aside form button menu dialog head label fieldset".split())
_AWAY_ROLE = frozenset("navigation contentinfo complementary search form dialog alertdialog banner menu menubar toolbar".split())
_AWAY_NAME = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer footnav sidebar sidenav aside widget widgets ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert popup popups modal overlay newsletter subscribe subscription signup login signin search share sharing social comment comments commentlist disqus reply replies respond responses related recommended recommendations pagination pager copyright toolbar skip hidden form".split()
)
_HEAD_NAME = frozenset("header masthead topbar".split())
#: Words that stand beside those in names of such elements; beside any other word a name tells nothing.
_BESIDE_NAME = frozenset(
    "site main page global local top bottom left right upper lower primary secondary first last box bar block section container wrapper wrap inner outer area panel group row col column list item items link links button buttons icon icons media text content body title head header wide narrow fixed sticky mobile desktop js post article blog entry user users social legal meta policy message msg close open toggle slot unit zone module region".split()
)
_PUNCTUATION = re.compile(r"[.,;:!?。，！？،]")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Deviations of the scores that content has at least.
DEVIATION = 1.0
#: What the score of a path is scaled by for each marked element in it, and for a link.
HINTED, LINKED = 0.02, 0.1
#: Elements whose blocks belong to the content around them, whatever their own ratios.
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li td th dd dt pre blockquote figcaption caption summary".split())
#: Elements of running text, whose names mostly say how they look; a name tells only without other words.
_TEXT = frozenset("p td th li dd dt h1 h2 h3 h4 h5 h6 pre blockquote".split())
_SMOOTH = (0.25, 0.5, 0.25)


class _Node:
    __slots__ = ("hints", "link", "parent", "path", "prose", "tag")

    def __init__(self, tag: str, parent: _Node | None, hinted: bool):
        self.tag, self.parent, self.hints = tag, parent, (parent.hints if parent else 0) + hinted
        self.path = f"{parent.path}/{tag}{'!' * hinted}" if parent else tag
        self.link = tag == "a" or bool(parent and parent.link)
        self.prose = tag if tag in _PROSE else parent.prose if parent and tag not in _BLOCK else ""


def _is_away(tag: str, attrs: str, parent: _Node) -> bool:
    if tag in _AWAY_TAG:
        return True
    inner = "/article" in parent.path or "/main" in parent.path
    if tag == "header" and not inner:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    beside = _AWAY_NAME if tag in _TEXT else _AWAY_NAME | _HEAD_NAME | _BESIDE_NAME
    for m in _ATTR.finditer(attrs):
        name, value = (m[1] or "hidden").lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.lower() in _AWAY_ROLE:
            return True
        if name in ("class", "id"):
            for token in value.split():
                names = {x.lower() for x in _NAME.findall(token) if not x.isdigit()}
                told = names & _AWAY_NAME or (not inner and names & _HEAD_NAME)
                if told and names <= beside:
                    return True
    return False


def _leaves(page: str) -> list[tuple[_Node, str, int]]:
    """(element, text, block number) of each text; the block number changes at block borders."""
    root = _Node("", None, False)
    stack, out, block, at = [root], [], 0, 0

    def text(raw: str) -> None:
        words = html.unescape(raw)
        if words and not words.isspace():
            out.append((stack[-1], words, block))
        elif words and out:
            out.append((stack[-1], " ", block))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            block += 1
        elif tag == "br" and out:
            out.append((stack[-1], " ", block))
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html", "div", "article", "section", "main"):
                    break
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES_P or tag == "p":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in _SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SAME[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in _SCOPE.get(tag, ()):
                    break
        parent = stack[-1]
        stack.append(_Node(tag, parent, _is_away(tag, m["attrs"] or "", parent)))
    if at < len(page):
        text(page[at:])
    return out


def _scores(leaves: list[tuple[_Node, str, int]]) -> dict[str, float]:
    """The fused ratio of text and punctuation of each path."""
    sums: dict[str, list[float]] = {}
    for node, words, _ in leaves:
        s = sums.setdefault(node.path, [0.0, 0.0, 0.0])
        s[0] += len(words) - words.count(" ")
        s[1] += len(_PUNCTUATION.findall(words))
        s[2] += 1
    ratio = {path: (s[0] / s[2], s[1] / s[2]) for path, s in sums.items()}
    rows = [ratio[node.path] for node, _, _ in leaves]
    fused: dict[str, float] = {}
    for k, (node, _, _) in enumerate(leaves):
        length = punctuation = weight = 0.0
        for step, w in zip((-1, 0, 1), _SMOOTH, strict=True):
            if 0 <= k + step < len(rows):
                length += w * rows[k + step][0]
                punctuation += w * rows[k + step][1]
                weight += w
        scale = HINTED**node.hints * (LINKED if node.link else 1.0)
        fused[node.path] = fused.get(node.path, 0.0) + (length / weight) * (0.5 + punctuation / weight) * scale
    return {path: x / sums[path][2] for path, x in fused.items()}


def _content_paths(leaves: list[tuple[_Node, str, int]]) -> set[str]:
    """Paths whose score stands out."""
    score = _scores(leaves)
    mean = sum(score.values()) / len(score)
    deviation = (sum((x - mean) ** 2 for x in score.values()) / len(score)) ** 0.5
    least = min(DEVIATION * deviation, max(score.values()))
    return {path for path, x in score.items() if x >= least}


def _container(root: _Node, solid: list[tuple[_Node, str, int]], paths: set[str]) -> _Node:
    held: dict[_Node, int] = {}
    below: dict[_Node, list[_Node]] = {}
    for node, words, _ in solid:
        if node.path in paths:
            for at in _above(node):
                if at not in held and at.parent is not None:
                    below.setdefault(at.parent, []).append(at)
                held[at] = held.get(at, 0) + len(words)
    at = root
    while inner := [n for n in below.get(at, ()) if 5 * held[n] >= 4 * held[root] and n.tag in _BLOCK and n.tag not in _PROSE]:
        at = inner[0]
    return next((n for n in _above(at) if n.tag in ("article", "main")), at)


def extract(page: str | None) -> str:
    """The main text of one page: blocks in order, one a line."""
    leaves = _leaves((page or "").replace("\x00", ""))
    solid = [x for x in leaves if not x[1].isspace()]
    if not solid:
        return ""
    paths = _content_paths(solid)
    container = _container(list(_above(solid[0][0]))[-1], solid, paths)
    inside: dict[_Node, bool] = {}
    blocks: dict[int, list[tuple[_Node, str]]] = {}
    for node, words, block in leaves:
        if node not in inside:
            inside[node] = any(n is container for n in _above(node))
        # a marked part in the midst of a block goes, be it content or not
        if inside[node] and (node.path in paths or node.hints == container.hints):
            blocks.setdefault(block, []).append((node, words))
    out = []
    for parts in blocks.values():
        text = " ".join("".join(w for _, w in parts).split())
        if not text:
            continue
        said = [(n, len(w)) for n, w in parts if not w.isspace()]
        content = any(n.path in paths for n, _ in said)
        linked = sum(size for n, size in said if n.link)
        if content or any(n.prose for n, _ in said) and (linked <= 0.7 * len(text) or any(n.prose not in ("", "li", "td", "dd") for n, _ in said)):
            out.append(text)
    return "\n".join(out)


def _above(node: _Node | None) -> Iterator[_Node]:
    while node is not None:
        yield node
        node = node.parent


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = [extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select("page_id", "url", "html")
    kind = dict(source.dtypes)
    return source.mapInArrow(run, f"page_id {kind['page_id']}, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
