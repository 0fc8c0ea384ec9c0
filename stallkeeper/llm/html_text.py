"""Main text of web pages by consensus of their hosts.

Each page's containers are scored by the running text in them, under a path of tags and classes with numbers generalised.
Spark adds the scores by host and path; the path with the most votes of a host is its article's place. Every page of the
host is then read again at that path, or, where it has no such container, at its own best one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm import words as W
from stallkeeper.session import stored

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript template xmp noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
#: Elements that never hold the article's text.
NOISE_TAGS = frozenset("nav header footer aside form script style noscript template button select option input textarea iframe object svg canvas head title dialog menu audio video map label fieldset math".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that mark an element as not belonging to the article.
NOISE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner banners promo promotion promotions sponsor sponsored sponsors cookie cookies consent gdpr notice notices
    notification alert nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars footer header masthead comment comments commentlist disqus replies reply
    respond share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget widgets skip toolbar search form""".split()
)
#: Elements that are never judged by their class.
KEPT = frozenset(("html", "body", "main", "article"))
#: A start of one of these ends an open element of the listed kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
FENCES = frozenset(("table", "ul", "ol", "dl", "select", "body", "html"))

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NUMBER = re.compile(r"\d+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """Text of a block, the containers around it (numbers, outermost first) and how many of its characters are links."""

    inside: tuple[int, ...]
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return _SPACE.sub(" ", "".join(self.parts)).strip()


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(next((x for x in m.groups()[1:] if x is not None), "")) for m in _ATTRIBUTE.finditer(text)}


def is_noise(tag: str, attrs: dict[str, str]) -> bool:
    if tag in NOISE_TAGS or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in NOISE_ROLES:
        return True
    style = attrs.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return True
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    return tag not in KEPT and any(x.lower() in NOISE_WORDS for x in _PARTS.findall(named))


def step(tag: str, attrs: dict[str, str]) -> str:
    """Generalised step of a path: the tag with its sorted classes, numbers replaced."""
    return ".".join([tag, *sorted({_NUMBER.sub("N", x) for x in attrs.get("class", "").split()})])


def blocks(html: str) -> tuple[list[Block], list[str]]:
    """Blocks of text outside noise, in page order, and the paths of the containers.

    Open elements end as browsers end them: a block start ends an open p, an item ends the item before, an end tag ends what
    is open inside its element, and one without an open element is skipped. Comments, raw text and declarations have no text.
    """
    found: list[Block] = []
    paths: list[str] = []
    stack: list[tuple[str, str, bool, int]] = []  # tag, path, noise, container or -1
    current: Block | None = None
    at, lower = 0, None

    def close(k: int) -> None:
        nonlocal current
        if any(t[0] in BLOCKS for t in stack[k:]):
            current = None
        del stack[k:]

    def add(text: str) -> None:
        nonlocal current
        if not text or stack and stack[-1][2]:
            return
        if current is None:
            if text.isspace():
                return
            current = Block(tuple(t[3] for t in stack if t[3] >= 0))
            found.append(current)
        plain = unescape(text)
        current.parts.append(plain)
        if any(t[0] == "a" for t in stack):
            current.linked += len(plain.strip())

    while m := _MARKUP.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in FENCES and tag not in BLOCKS:
                    break
            else:
                if tag in BLOCKS:
                    current = None
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
            current = None
        if tag in ("td", "th"):
            add(" ")
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ENDS.get(tag, ()):
                close(k)
                break
            if stack[k][0] in FENCES:
                break
        if tag in VOID:
            continue
        attrs = attributes(m[3]) if m[3].strip() else {}
        noise = bool(stack and stack[-1][2]) or is_noise(tag, attrs)
        path = f"{stack[-1][1]}>{step(tag, attrs)}" if stack else step(tag, attrs)
        if tag in RAW:
            lower = lower if lower is not None else html.lower()
            end = lower.find(f"</{tag}", at)
            at = len(html) if end < 0 else end
            if end >= 0:
                at = html.find(">", end) + 1 or len(html)
            continue
        number = -1
        if tag in CONTAINERS and not noise:
            number = len(paths)
            paths.append(path)
        stack.append((tag, path, noise, number))
    add(html[at:])
    return found, paths


def container_scores(found: list[Block], paths: list[str]) -> dict[str, float]:
    """Points of each path. A block gives its unlinked characters to the container around it, half of them to the next and so
    on; elements made for articles count double, and what is mostly links counts nothing."""
    points: dict[str, float] = {}
    for block in found:
        size = len(block.text())
        if not size or block.linked * 2 > size:
            continue
        weight = float(size - block.linked)
        for k in reversed(block.inside):
            last = paths[k].rpartition(">")[2].partition(".")[0]
            points[paths[k]] = points.get(paths[k], 0.0) + weight * (2.0 if last in ("article", "main") else 1.0)
            weight /= 2
    return points


def best_path(points: dict[str, float]) -> str | None:
    return min(points, key=lambda p: (-points[p], p)) if points else None


def text_at(found: list[Block], paths: list[str], path: str | None) -> str:
    """Blocks inside the containers of a path, in page order; all blocks if there is no container."""
    inside = {k for k, p in enumerate(paths) if p == path}
    kept = [b.text() for b in found if path is None or inside.intersection(b.inside)]
    return "\n".join(x for x in kept if x)


def host() -> Column:
    """The host of column `url` in lower case, without www; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?(?:www\.)?([^/:?#]+)", 1), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, points, pages) from all `pages` (host, html), added up within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column(0).to_pylist()
            total: dict[tuple[str, str], list[float]] = {}
            for lo, hi, data, offsets in W.slices(batch.column(1)):
                raw = data.tobytes()
                for k in range(hi - lo):
                    for path, points in container_scores(*blocks(raw[offsets[k] : offsets[k + 1]].decode())).items():
                        own = total.setdefault((hosts[lo + k], path), [0.0, 0])
                        own[0] += points
                        own[1] += 1
            rows = [(h, p, v, n) for (h, p), (v, n) in total.items()]
            if rows:
                kinds = (pa.string(), pa.string(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "path", "points", "pages"])

    found = pages.select("host", "html").mapInArrow(run, "host string, path string, points double, pages long")
    return found.groupBy("host", "path").agg(F.sum("points").alias("points"), F.sum("pages").alias("pages"))


def consensus(voted: DataFrame) -> DataFrame:
    """(host, winner): the path with most points of each host; ties go to more pages, then to the first path."""
    return voted.groupBy("host").agg(F.min_by("path", F.struct((-F.round("points", 3)).alias("a"), (-F.col("pages")).alias("b"), "path")).alias("winner"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of `pages` (page_id, url, html, ...).

    Texts have their blocks on lines of their own. A null or empty page, or one without text outside noise, has the empty
    text. Pages without a host vote together. Repeated rows give repeated results. A page without its host's winning container
    is read at its own best one, or as a whole if it has none. Other columns are not read.
    """
    rows = pages.select("page_id", "url", "html").withColumn("host", host())
    winners = stored(consensus(votes(rows)), "winners")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            winner = batch.column(3).to_pylist()
            for lo, hi, data, offsets in W.slices(batch.column(2)):
                raw, out = data.tobytes(), []
                for k in range(hi - lo):
                    found, paths = blocks(raw[offsets[k] : offsets[k + 1]].decode())
                    path = winner[lo + k]
                    if path not in paths:
                        path = best_path(container_scores(found, paths))
                    out.append(text_at(found, paths, path))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(out, pa.string())], ["page_id", "url", "text"])

    schema = pages.select("page_id", "url").schema.add("text", "string")
    placed = rows.join(winners, "host", "left").select("page_id", "url", "html", "winner")
    return placed.mapInArrow(run, schema)
