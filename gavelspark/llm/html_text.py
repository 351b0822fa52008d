"""Main text of web pages by consensus of the pages of a host.

Each page scores its containers by the text they hold, without links and without what is plainly not the article. From the best one
it climbs to the article or main around it, else to ancestors that add headings, paragraphs or a part of comparable size. The path reached,
its tags and classes from the root down with digits generalised, is the page's vote. Votes are counted for each host in
Spark, combined in each task first, and each page is extracted again with the winning path of its host; a page without
such a container, without a host, or with less than a third of its best one's unlinked text there (another template of the host), uses its own best one.

A boilerplate word that begins a class name or id removes the element, unless that wraps the page's main part; elsewhere in a name it does so
only where the element holds a small part of the page's unlinked text. Names such as has-comments or no-header say nothing of the element.

Blocks are what block-level tags separate; character references are decoded, runs of white space become one space. Defined
results: null and empty pages have an empty text; markup that never ends is closed at the end of the page; pages with equal
ids are extracted each by itself; other columns are left alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
RAW = "script style noscript template textarea title select option svg math iframe object audio video canvas"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body center".split())
NEVER = frozenset("head nav footer aside form menu dialog button fieldset".split())
WHOLE = ("article", "main")
COMPARABLE = 4  # a sibling part with a quarter of the best container's text belongs to the article
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disclaimer disqus "
    "footer form gdpr header hidden login masthead menu modal nav navbar navigation navigator newsletter notice notices notification overlay pager "
    "pagination paywall popup promo promoted promotion recommended related replies respond rss search share sharing shares sidebar signup skip social "
    "sponsor sponsored subscribe subscription tags toolbar topbar widget".split())
MODIFIERS = frozenset("has have with without no not is".split())
NEVER_BY_WORD = frozenset("html body main article".split())
HEADINGS = frozenset("header hgroup h1 h2 h3 h4 h5 h6".split())
OTHER_TEMPLATE = 3  # the winning path is not the page's if its own best one holds more than three times the text
SMALL = 4  # a small part is at most a quarter
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW.replace(" ", "|") + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>"
    r"|<(?P<loose_end>/?)(?P<loose_tag>[a-z][a-z0-9:-]*)(?P<loose_rest>[^<>]*)>|<[!?][^>]*>", re.I | re.S)
# The tag alternative never gives back what it took (possessive), so a tag that is never closed costs one pass, not one for
# each way of pairing its quotes; where quotes leave no `>`, the loose alternative ends the tag at the first `>` instead.
_ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
_HOST = re.compile(r"://([^/?#]*)")


@dataclass
class Container:
    path: str
    parent: int
    tag: str = ""
    blocks: list[int] = field(default_factory=list)


def host_of(url: str | None) -> str:
    """The host as the url filters see it: after the first ://, A-Z lower-cased."""
    found = _HOST.search(url or "")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found[1]) if found else ""


def _describe(tag: str, rest: str) -> tuple[str, bool, str]:
    """(generalised step of a path, whether the element is boilerplate, where a boilerplate word makes it likely: head, inner or empty)."""
    if not rest or "=" not in rest:
        return tag, "hidden" in rest.split(), ""
    known = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)}
    names = known.get("class", "").split()
    gone = (
        known.get("role", "").lower() in ROLES or known.get("aria-hidden") == "true"
        or "display:none" in known.get("style", "").replace(" ", "").lower())
    return ".".join([tag, *sorted(_DIGITS.sub("#", n) for n in names)]), gone, _likely(tag, [*names, known.get("id", "")])


def _likely(tag: str, names: list[str]) -> str:
    found = ""
    for name in names if tag not in NEVER_BY_WORD else ():
        words = [w.lower() for w in _PART.findall(_CAMEL.sub(" ", name))]
        if words and words[0] not in MODIFIERS:
            if words[0] in BOILERPLATE:
                return "head"
            if any(w in BOILERPLATE and not (w == "header" and tag in HEADINGS) for w in words):
                found = "inner"
    return found


@dataclass
class Suspect:
    """An element that a word of its class or id makes likely to be boilerplate."""

    parent: int
    where: str
    main: bool = False  # holds a headline or main


class Page:
    """Blocks of text outside boilerplate, each with its innermost container and the length of its links."""

    def __init__(self, source: str):
        self.containers = [Container("", -1)]
        self.blocks: list[tuple[str, int]] = []
        self.prose: set[int] = set()  # blocks that are headings or paragraphs
        suspects, within = [Suspect(-1, "")], []  # for each block its innermost suspect
        stack: list[tuple[str, bool, int, str, int]] = [("", False, 0, "", 0)]  # tag, boilerplate, container, path, suspect
        text: list[str] = []
        linked, in_link, at = 0, False, 0

        def flush() -> None:
            nonlocal linked
            if text:
                block = " ".join(html.unescape("".join(text)).split())
                if block:
                    holder = stack[-1][2]
                    self.containers[holder].blocks.append(len(self.blocks))
                    if stack[-1][0] in CLOSED_BY_BLOCK:
                        self.prose.add(len(self.blocks))
                    self.blocks.append((block, min(linked, len(block))))
                    within.append(stack[-1][4])
                text.clear()
            linked = 0

        for token in _TOKEN.finditer(source):
            if token.start() > at and not stack[-1][1]:
                text.append(source[at:token.start()])
                linked += (token.start() - at) * in_link
            at = token.end()
            loose = token["tag"] is None
            tag, end, rest = (token["loose_tag"], token["loose_end"], token["loose_rest"]) if loose else (token["tag"], token["end"], token["rest"])
            if not tag:
                continue
            tag = tag.lower()
            if tag == "a":
                in_link = not end
            if tag == "br" or (tag in VOID and tag != "hr"):
                text.append(" ")
            if tag not in BLOCKS and tag not in NEVER:
                continue
            flush()
            if tag in VOID:
                continue
            if end:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                continue
            if stack[-1][0] in CLOSED_BY_BLOCK or (tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == tag):
                stack.pop()
            step, gone, likely = _describe(tag, rest)
            _, outer, holder, path, suspect = stack[-1]
            path = f"{path}>{step}" if path else step
            gone |= outer or tag in NEVER or (tag == "header" and "article" not in path and "main" not in path)
            if tag in CONTAINERS and not gone:
                self.containers.append(Container(path, holder, tag))
                holder = len(self.containers) - 1
            if likely and not gone:
                suspects.append(Suspect(suspect, likely))
                suspect = len(suspects) - 1
            if tag in ("main", "h1") and not gone:
                at_suspect = suspect
                while at_suspect and not suspects[at_suspect].main:
                    suspects[at_suspect].main = True
                    at_suspect = suspects[at_suspect].parent
            stack.append((tag, gone, holder, path, suspect))
            if rest.endswith("/") and tag not in CONTAINERS:
                stack.pop()
        if not stack[-1][1]:
            text.append(source[at:])
        flush()
        if len(suspects) > 1:
            self._drop(suspects, within)

    def _drop(self, suspects: list[Suspect], within: list[int]) -> None:
        """Takes the blocks of boilerplate elements out of their containers: heads first, then small parts of what is left."""
        gone = [False] * len(suspects)
        for where in ("head", "inner"):
            size = [0] * len(suspects)
            for (text, linked), suspect in zip(self.blocks, within, strict=True):
                size[suspect] += 0 if gone[suspect] else len(text) - linked
            for k in range(len(suspects) - 1, 0, -1):
                size[suspects[k].parent] += size[k]
            for k in range(1, len(suspects)):
                suspect = suspects[k]
                if suspect.where == where:
                    gone[k] = not (suspect.main and 2 * size[k] > size[0]) if where == "head" else SMALL * size[k] <= size[0]
                gone[k] |= gone[suspect.parent]
        for container in self.containers:
            container.blocks = [b for b in container.blocks if not gone[within[b]]]

    def _unlinked(self, blocks: Iterable[int]) -> int:
        return sum(len(text) - linked for text, linked in (self.blocks[b] for b in blocks))

    def best(self) -> str | None:
        """Path of the article: from the container with most unlinked text up to what holds the rest of it.

        An outer container counts its own children's text fully, deeper text by halves.
        """
        score = Counter()
        for k, container in enumerate(self.containers):
            own = self._unlinked(container.blocks)
            share, at, depth = float(own), k, 0
            while own and at >= 0:
                score[at] += share
                at, depth = self.containers[at].parent, depth + 1
                share = own * (1.0 if depth == 1 and len(container.blocks) < 2 else 0.5 ** depth)
        if not score:
            return None
        top = max(score.values())
        return self.containers[self._climbed(next(k for k in range(len(self.containers)) if score[k] == top))].path

    def _climbed(self, best: int) -> int:
        """The nearest article, else main, around a container, and on to ancestors that hold more of the same text."""
        free = [self._unlinked(c.blocks) for c in self.containers]  # unlinked and all text, with what is below
        full = [sum(len(self.blocks[b][0]) for b in c.blocks) for c in self.containers]
        parts = defaultdict(list)
        for k in range(len(self.containers) - 1, 0, -1):
            parent = self.containers[k].parent
            free[parent] += free[k]
            full[parent] += full[k]
            parts[parent].append(k)
        above = [best]
        while self.containers[above[-1]].parent >= 0:
            above.append(self.containers[above[-1]].parent)

        def adds(outer: int, inner: int) -> bool:
            """What the outer one adds is text, not links."""
            return 2 * (free[outer] - free[inner]) >= full[outer] - full[inner]

        tags = [c.tag for c in self.containers]
        at = next((k for tag in WHOLE for k in above if tags[k] == tag and adds(k, best)), best)
        size, whole = free[at], tags[at] in WHOLE
        reached = below = at
        for outer in above[above.index(at) + 1:]:
            own = [self.blocks[b] for b in self.containers[outer].blocks if b in self.prose]
            more = 2 * sum(linked for _, linked in own) < sum(len(text) for text, _ in own) and not (whole and tags[outer] in ("", "body"))
            more = more or not whole and any(k != below and free[k] * COMPARABLE >= size and 2 * free[k] >= full[k] for k in parts[outer])
            if more and adds(outer, reached):
                reached = outer
            below = outer
        return reached

    def _of(self, path: str) -> list[int]:
        """All blocks inside containers of this path, in page order."""
        inside = set()
        for k, container in enumerate(self.containers):
            if container.path == path or container.parent in inside:
                inside.add(k)
        return sorted(b for k in inside for b in self.containers[k].blocks)

    def text(self, path: str) -> str:
        return "\n\n".join(self.blocks[b][0] for b in self._of(path))

    def article(self, path: str | None) -> str:
        """The text of the host's winning path, or of the page's own best one where that holds much more."""
        own = self.best()
        if own is None or own == path:
            return self.text(path) if path is not None else ""
        if path is not None:
            wanted = self._of(path)
            if wanted and OTHER_TEMPLATE * self._unlinked(wanted) >= self._unlinked(self._of(own)):
                return self.text(path)
        return self.text(own)


def consensus(pages: DataFrame) -> DataFrame:
    """(host, path): the path most pages of the host vote for; the first by code point of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = Counter()
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host = host_of(url)
                path = Page(source).best() if host and source else None
                if path is not None:
                    votes[host, path] += 1
            hosts, paths = zip(*votes, strict=True) if votes else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes.values(), pa.int64())], ["host", "path", "votes"])

    cast = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    counted = cast.mapInArrow(run, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    return counted.withColumn("place", place).where("place = 1").select("host", "path")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True):
                texts.append(Page(source or "").article(path))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    cast = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.translate(F.regexp_extract("url", "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    joined = cast.withColumn("host", host).join(consensus(pages), "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
