"""Main text of web pages by a vote of each host's pages.

Each page is parsed once and its containers are scored from the inside out. A container
counts the running text that stands in it and in no container inside of it, with text in
links against it; to that it adds the score of its best inner container, and a part of
the others'. Text of its own next to an inner container shows that both belong to one
article; an inner container alone wins over the one around it. Lists, tables, quotes and
paragraphs are no containers, and menus, adverts, comments and the like count nothing. A
page votes for the path of its best container, made of tags and classes with digits
generalised. Votes are added up by host and path in Spark, and the path with the most
pages wins its host. Then every page is extracted again at its host's winning path; a
page without such a container takes its own best one, and one without any takes its body.

An element is left out by its tag, role or hidden state, or by a class name or id whose
every part (between hyphens, underscores and capitals) is a word for such a thing or an
addition to one: ``ad``, ``site-header`` and ``post_comments``, but neither ``no-sidebar``
nor ``social-life``.

A path is a hash of its parent's and its own label, so that memory is linear in the page
however deep it is nested; open elements are found by tag, so that time is, too. Winning
paths, one per host, are broadcast while there are no more than ``MOST_HOSTS`` of them,
and joined by host otherwise.

Blocks end at block elements and line breaks. In a block character references are
decoded, white space becomes one space, and the ends are trimmed; blocks are joined by a
newline in page order, and empty ones left out. A formula is part of its line.

Defined results: null, empty or markup-only html gives an empty text; a null url is the
empty host. Markup that is cut off or not closed is read as far as it goes, at any depth
and length. Repeated rows vote and are extracted each on its own; a tie between paths goes
to the higher score, then to the later path. An empty table gives an empty table. Columns
to keep whose names clash with ``text`` or ``n_chars`` give way to the results.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.arrowtext import cut, slices
from weft.llm.url_cascade import split_url

MOST_HOSTS = 50_000

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed".split())
_MATH = frozenset("math mi mo mn ms mtext mrow msup msub mfrac msqrt mroot msubsup munder mover munderover mmultiscripts mtable mtr mtd mstyle mspace mpadded mphantom menclose semantics annotation annotation-xml".split())
_INLINE = _MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are never main text.
_SKIPPED = frozenset("head nav header footer aside form script style textarea title noscript template iframe object svg canvas button select option dialog menu map audio video xmp noembed annotation annotation-xml".split())
#: Words for what is no main text, and words that are added to them in class names and ids.
_SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner banners breadcrumb breadcrumbs comment comments disqus respond replies consent cookie cookies copyright "
    "dialog disclaimer footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices alert alerts overlay pager pagination popup promo promos promoted promotion "
    "recommended related share sharing sidebar sidebars signup social sponsor sponsors sponsored subscribe subscription toolbar topbar".split()
)
_ADDED_WORDS = frozenset(
    "main site page post posts entry article articles story stories top bottom left right upper lower primary secondary global mobile desktop sub side list lists area areas section box bar block "
    "wrapper wrap container inner outer holder panel row link links item items icon icons button buttons slot unit form media network networks reader readers user users thread x".split()
)
_SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar note".split())
_NEVER_SKIPPED = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes first, and the elements that it does not look beyond.
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_CLOSES = {k: (tuple(a.split()), tuple(b.split())) for k, (a, b) in _CLOSES.items()}
_HEADING_OR_P = frozenset("p h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = frozenset("html body div section article main center".split())
#: Cells are containers only if they hold one of these.
_CELLS, _IN_CELLS = frozenset("td th".split()), frozenset("p div section article".split())

#: Parts of an inner container's score that the one around takes over: of the best one beside own text, of the best one
#: alone, and of the others; own text counts from this share of the best one's. An element named for an article counts more.
WITH_OWN, ALONE, OTHERS, OWN_FROM = 1.0, 0.95, 0.3, 0.04
NAMED = {"article": 1.2, "main": 1.05}


@dataclass(slots=True)
class Node:
    tag: str
    path: int
    label: str
    up: int
    skipped: bool
    text: list[tuple[int, str]] | None = None
    prose: int = 0
    linked: int = 0
    end: int = 0


def _is_other(name: str) -> bool:
    """Whether a class name or id says that the element is no main text."""
    parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
    return any(x in _SKIPPED_WORDS for x in parts) and all(x in _SKIPPED_WORDS or x in _ADDED_WORDS for x in parts)


def _label(tag: str, attrs: str) -> tuple[str, bool]:
    """Tag and classes with digits generalised, and whether the element is no main text."""
    if not attrs.strip(" /\t\r\n"):
        return tag, tag in _SKIPPED
    known = {}
    for m in _ATTR.finditer(attrs):
        known.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    classes = _html.unescape(known.get("class", "")).split()
    label = ".".join((tag, *sorted({re.sub(r"\d+", "#", c.lower()) for c in classes})))
    if tag in _NEVER_SKIPPED:
        return label, False
    gone = tag in _SKIPPED or known.get("role", "").lower() in _SKIPPED_ROLES or any(map(_is_other, classes)) or _is_other(known.get("id", ""))
    gone = gone or "hidden" in known or known.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", known.get("style", "").lower()))
    return label, gone


def parse(text: str) -> list[Node]:
    """Block elements in page order; each has its own text as (block number, piece), and the index after its last descendant."""
    nodes = [Node("", 0, "", -1, False)]
    at, block, links = 0, 0, 0
    inline_skip: list[str] = []
    open_of: dict[str, list[int]] = defaultdict(list)
    cells: dict[int, int] = defaultdict(int)
    pos, size = 0, len(text)

    def say(piece: str) -> None:
        node = nodes[at]
        if piece and not inline_skip:
            if node.text is None:
                node.text = []
            node.text.append((block, piece))
            if not node.skipped:
                n = len(piece.strip())
                if links:
                    node.linked += n
                else:
                    node.prose += n

    def close(to: int) -> None:
        """Ends elements up to and with node ``to``."""
        nonlocal at
        while True:
            node = nodes[at]
            node.end = len(nodes)
            if at:
                open_of[node.tag].pop()
            done = at == to
            at = node.up
            if done:
                return

    def nearest(tags: tuple[str, ...]) -> int:
        return max((open_of[t][-1] for t in tags if open_of.get(t)), default=0)

    while pos < size:
        m = _TAG.search(text, pos)
        if m is None:
            say(text[pos:])
            break
        if m.start() > pos:
            say(text[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # a closing tag
            if tag in _INLINE:
                if tag == "a":
                    links = max(0, links - 1)
                if inline_skip and inline_skip[-1] == tag:
                    inline_skip.pop()
                continue
            block += 1
            if open_of.get(tag):
                close(open_of[tag][-1])
                links, inline_skip[:] = 0, []
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 1
            if tag not in _VOID and not m[3].rstrip().endswith("/") and (inline_skip or _label(tag, m[3])[1]):
                inline_skip.append(tag)
            continue
        block += 1
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*[^>]*(?:>|\\Z)", re.I).search(text, pos)
            pos = end.end() if end else size
            continue
        if nodes[at].tag in _HEADING_OR_P and (nodes[at].tag == "p" or tag in _HEADING_OR_P):
            close(at)
            links = 0
        if tag in _CLOSES:
            closes, stops = _CLOSES[tag]
            k = nearest(closes)
            if k > nearest(stops):
                close(k)
        label, gone = _label(tag, m[3])
        if tag in _CELLS:  # columns of a layout are told apart
            cells[at] += 1
            label = f"{label}:{cells[at]}"
        parent = nodes[at]
        path = xxhash.xxh3_64_intdigest(f"{parent.path}/{label}") & (2**63 - 1)
        nodes.append(Node(tag, path, label, at, parent.skipped or gone))
        at = len(nodes) - 1
        open_of[tag].append(at)
        if m[3].rstrip().endswith("/"):
            close(at)
    while at >= 0:
        close(at)
    return nodes


def best(nodes: list[Node]) -> tuple[int, float]:
    """The container with the highest score, and that score; (-1, 0) if no text counts."""
    n = len(nodes)
    prose, linked, first, rest = [x.prose for x in nodes], [x.linked for x in nodes], [0.0] * n, [0.0] * n
    holds = [False] * n  # a cell that has blocks
    top, high = -1, 0.0
    for k in range(n - 1, -1, -1):  # what is inside of an element comes after it
        x = nodes[k]
        if x.skipped:
            continue
        if x.tag in _IN_CELLS:
            holds[x.up] = True
        if k == 0 or x.tag in _CONTAINERS or (x.tag in _CELLS and holds[k]) or "-" in x.tag:
            own = max(0.0, prose[k] - 2.0 * linked[k])
            score = own + OTHERS * rest[k] + (WITH_OWN if own > OWN_FROM * first[k] else ALONE) * first[k]
            score *= NAMED.get(x.tag, 1.0)
            if score > 0 and score >= high:  # the outer one of equals: it comes later here
                top, high = k, score
            if k:
                up = x.up
                low, first[up] = sorted((score, first[up]))
                rest[up] += low
        elif k:
            up = x.up
            prose[up] += prose[k]
            linked[up] += linked[k]
            low, first[up] = sorted((first[k], first[up]))
            rest[up] += low + rest[k]
    return top, high


def blocks(nodes: list[Node], k: int) -> list[tuple[int, str]]:
    """Numbered blocks of a container's text, cleaned."""
    pieces: list[tuple[int, int, str]] = []
    j = k
    while j < nodes[k].end:
        if nodes[j].skipped and j != k:
            j = nodes[j].end
            continue
        pieces += [(b, j, t) for b, t in nodes[j].text or ()]
        j += 1
    joined: dict[int, list[str]] = {}
    for b, _, t in sorted(pieces, key=lambda p: p[0]):
        joined.setdefault(b, []).append(t)
    out = [(b, " ".join(_html.unescape("".join(t)).split())) for b, t in joined.items()]
    return [x for x in out if x[1]]


def described(nodes: list[Node], k: int, most: int = 12) -> str:
    """The last labels of a node's path, to be read by people; the path's hash tells it apart."""
    out = []
    while k > 0 and len(out) < most:
        out.append(nodes[k].label)
        k = nodes[k].up
    return "/".join(reversed(out)) if k <= 0 else ".../" + "/".join(reversed(out))


def vote(text: str | None) -> tuple[int, str, float] | None:
    """Hash and description of the best container's path, and its score."""
    nodes = parse(text or "")
    k, score = best(nodes)
    return None if k < 0 else (nodes[k].path, described(nodes, k), score)


def extract(text: str | None, path: int | None) -> str:
    """The main text at ``path``, or at the page's own best container if there is none there."""
    nodes = parse(text or "")
    found, k = [], 0
    while k < len(nodes):  # containers inside a found one are part of it
        if path is not None and nodes[k].path == path and not nodes[k].skipped:
            found.append(k)
            k = nodes[k].end
        else:
            k += 1
    out = [b for k in found for b in blocks(nodes, k)]
    if not out:
        k, _ = best(nodes)
        out = blocks(nodes, max(k, 0))
    return "\n".join(t for _, t in out)


def _votes(pages: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                got = [vote(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("host"), pa.array([g and g[0] for g in got], pa.int64()), pa.array([g and g[1] for g in got], pa.string()), pa.array([g[2] if g else 0.0 for g in got], pa.float64())],
                    ["host", "key", "path", "score"],
                )

    return pages.mapInArrow(run, "host string, key long, path string, score double").where("key IS NOT NULL")


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, key, path, n_pages, score): of each host the path that most pages voted for; ties go to the higher score, then the later path."""
    rows = pages.select(split_url(F.col(url).cast("string"))[0].alias("host"), F.col(html).cast("string").alias("html"))
    counts = _votes(rows).groupBy("host", "key").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.min("path").alias("path"))
    top = counts.groupBy("host").agg(F.max(F.struct("n", F.round("score", 3).alias("score"), "path", "key")).alias("top"))
    return top.select("host", "top.key", "top.path", F.col("top.n").alias("n_pages"), "top.score")


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), most_hosts: int = MOST_HOSTS) -> DataFrame:
    """``keep`` columns, ``text``, and ``n_chars``, its code points."""
    names = [c for c in keep if c not in ("text", "n_chars")]
    winners = winning_paths(pages, url, html).select(F.col("host").alias("__h"), F.col("key").alias("__path"))
    rows = pages.select(*names, split_url(F.col(url).cast("string"))[0].alias("__host"), F.col(html).cast("string").alias("__html"))
    winners = cut(winners)
    if winners.count() <= most_hosts:
        got = {r["__h"]: r["__path"] for r in winners.collect()}
        shared, joined, of = pages.sparkSession.sparkContext.broadcast(got), rows, None
    else:
        joined, shared, of = rows.join(winners, F.col("__host") == F.col("__h"), "left"), None, "__path"

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__html"):
                paths = part.column(of).to_pylist() if of else [shared.value.get(h) for h in part.column("__host").to_pylist()]
                text = [extract(x.as_py(), p) for x, p in zip(part.column("__html"), paths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*names, "text", "n_chars"]
                )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*names).schema]
    return joined.mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
