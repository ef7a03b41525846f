"""Main-text extraction by consensus host paths.

1. Each page is parsed once; every container gets a score (text of its paragraphs, less linked text, half of a
   child's score) and the best one votes with its score for its generalised path: tags with their classes
   (digits read as #) from the root down.
2. Votes are summed per host in Spark; the host's winning path is the one with the most.
3. Each page is parsed again and its text taken from the elements on its host's winning path; a page without
   such an element (or with nothing in it) falls back to its own best container.

Inside the chosen element, subtrees that are menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, scripts or styles by tag, role, class or id, and hidden ones, are left out. A class or id says so by its last word
(``site-header``), or if its first word does and the others only say what sort of box it is (``comment-list``,
``sidebar-2``): ``post-header-layout`` and ``comment-free`` are names of something else, as is ``has-sidebar``. An inline element
is left out only if every word of one of its classes says so; and an element with a page's main heading or <main> and more than half of
its text is no boilerplate whatever its class or, for a form, its tag. Block elements part blocks; inline tags
(left out or not) don't, and a line break is white space. Character references are decoded; white space inside a block becomes
one space.

Scale: pages are never shuffled while the table of winners (one short row a host) is under ``broadcast_bytes``
(checked); beyond it pages are joined by host, where AQE splits a hot host. Votes of a hot host are summed in
tasks first.

Rows: null or empty html has an empty text; null urls and urls without a host share one nameless host; broken,
unclosed and very long markup is read to its end (one pass, linear); repeated rows keep their rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices, unused

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i ins kbd label mark math q s samp small span strong sub sup time tt u var".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul hr".split())
#: What closes an open <p>, and which siblings close each other.
ENDS_P = BLOCK - frozenset("html head body td th tr tbody thead tfoot li dd dt summary figcaption".split())
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("article body div main section td blockquote".split())
BOILER_TAGS = frozenset("nav header footer aside form button menu dialog".split()) | RAW
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars aside rail widget widgets menu menus "
    "nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer foot comment comments commentlist respond disqus discussion reply replies notice notices cookie cookies "
    "consent gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager skip tags toolbar form search".split()
)
_TAG_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)(?=[\s/>])")
_MARK = re.compile("[>\"']")
_ATTR = re.compile(r"([^\s/=>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")  # one attribute with its value
_NAME = re.compile(r"[A-Za-z]+")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
# First words of classes that tell of other elements, and words beside names that add nothing.
ABOUT = frozenset("has have with without no not is js hide show".split())
BESIDE = frozenset("link links button btn icon icons box text item label list wrapper container".split())
# Words in names of block elements that say what sort of box it is.
BOXES = BESIDE | frozenset("buttons items wrap area section block row col column panel slot unit bar inner outer content body posts articles stories group".split())
_DIGITS = re.compile(r"\d+")


class Path:
    """A step of a generalised path; a page's paths share their beginnings, and are told apart by identity."""

    __slots__ = ("up", "step", "depth", "matched")

    def __init__(self, up: Path | None, step: str, matched: bool = False):
        self.up, self.step, self.depth = up, step, up.depth + 1 if up else 0
        self.matched = (up.matched if up else 0) + matched  # how many steps from the root agree with the chosen path

    def text(self) -> str:
        steps, at = [], self
        while at.up is not None:
            steps.append(at.step)
            at = at.up
        return "/" + "/".join(reversed(steps))


class Element:
    __slots__ = ("tag", "path", "boiler", "inside", "sound", "holder", "up")

    def __init__(self, tag: str, path: Path, boiler: bool, parent: Element | None, inside: bool):
        self.tag, self.path, self.boiler, self.inside = tag, path, boiler, inside
        self.sound = parent.sound if boiler and parent else self  # the nearest that is no boilerplate
        self.holder = self if parent is None or tag in CONTAINERS else parent.holder  # the nearest container
        self.up = parent.holder if parent else None  # the nearest container above


def _named(tag: str, name: str) -> bool:
    """Whether one class or id says boilerplate."""
    found = [n.lower() for n in _NAME.findall(name)]
    if not found or found[0] in ABOUT:
        return False
    told = [n in BOILER_NAMES for n in found]
    beside = BESIDE if tag in INLINE else BOXES
    whole = any(told) and all(t or n in beside for t, n in zip(told, found, strict=True))
    return whole or tag not in INLINE and told[-1]


class Scanner:
    """Markup in order: ``(start, end, name, attributes, closing)`` of each tag; name None for comments and the like. Nothing is
    looked for twice that the rest of the page doesn't hold."""

    def __init__(self, page: str):
        self.page, self.quotes, self.gone, self.last = page, True, set(), page.rfind(">")

    def find(self, what: str, at: int) -> int:
        """Where what ends, -1 if nowhere."""
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
            return -1
        return found + len(what)

    def tag_end(self, at: int) -> int:
        """Where a tag ends whose name ends at ``at``: its first > outside of quotes; once quotes don't pair up to any,
        the first > at all."""
        end = self.find(">", at)
        if self.quotes and end > 0:
            inside = self.page[at:end]
            if '"' not in inside and "'" not in inside:
                return end
            pos = at
            while m := _MARK.search(self.page, pos):
                if m[0] == ">":
                    return m.end()
                closed = self.find(m[0], m.end())
                pos = closed if closed > 0 else m.end()
            self.quotes = False
        return end

    def next(self, at: int) -> tuple[int, int, str | None, str, bool] | None:
        page = self.page
        while 0 <= (start := page.find("<", at)) < self.last:
            if (m := _TAG_NAME.match(page, start)) and (end := self.tag_end(m.end())) > 0:
                return start, end, m[1].lower(), page[m.end():end - 1], page[start + 1] == "/"
            if page.startswith("<!--", start):
                end = self.find("-->", start + 4)
                return start, end if end > 0 else len(page), None, "", False
            if page.startswith("<![CDATA[", start) and (end := self.find("]]>", start)) > 0:
                return start, end, None, page[start + 9:end - 3], False
            if page.startswith(("<!", "<?"), start):
                return start, self.find(">", start), None, "", False
            at = start + 1
        if (start := page.find("<!--", at)) >= 0:  # without an end
            return start, len(page), None, "", False
        return None

    def raw_end(self, tag: str, at: int) -> int:
        """Where a raw element ends. Without an end tag a script or style runs to the end of the page, others hold nothing."""
        if f"</{tag}" not in self.gone:
            if stop := re.compile(rf"</{tag}\s*>", re.I).search(self.page, at):
                return stop.end()
            self.gone.add(f"</{tag}")
        return len(self.page) if tag in ("script", "style") else at


@lru_cache(4096)
def _described(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """A step of a path, whether the element is boilerplate, and whether that is by its looks only."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}
    classes = found.get("class", "").split()
    sure = tag in BOILER_TAGS and tag != "form" or found.get("role", "").lower() in BOILER_ROLES
    sure = sure or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(found.get("style", "")))
    looks = tag == "form" or tag not in ("html", "body", "article", "main") and any(_named(tag, c) for c in [*classes, found.get("id", "")])
    return ".".join([tag, *sorted(_DIGITS.sub("#", c).replace("/", "|") for c in classes)]), sure or looks, looks and not sure


def walk(page: str, chosen: str | None = None, cleared: frozenset[int] = frozenset()) -> tuple[dict[Path, float], list[str]]:
    """Scores of containers by path, and the blocks of text in elements on the chosen path. cleared are elements (by their
    number) that only look like boilerplate; a page that has some is walked once more."""
    steps = chosen.split("/")[1:] if chosen and chosen != "/" else []
    top = Path(None, "")
    root = Element("", top, False, None, chosen == "/")
    scan, stack, paths, scores, blocks, pending = Scanner(page), [root], {}, {}, [], []
    opened: dict[str, list[int]] = {}  # by tag the depths of its open elements
    blocky: list[int] = []  # depths of open block elements
    links, at, took = 0, 0, 0  # open links; characters of linked text in the block
    number, total, mains, looking, wrong = 0, 0, 0, {}, []  # elements, characters, main headings so far; by depth what a looking root began with

    def flush(owner: Element) -> None:
        nonlocal took
        if pending:
            text = " ".join(entities.unescape("".join(pending)).split())
            pending.clear()
            owner = owner.sound
            if text:
                if owner.inside:
                    blocks.append(text)
                value, up = max(0.0, len(text) - 2.0 * took), owner.holder
                for _ in range(2):
                    if up is None:
                        break
                    scores[up.path] = scores.get(up.path, 0.0) + value
                    value, up = value / 2, up.up
        took = 0

    def close(depth: int) -> None:
        """Close all elements at this depth and deeper."""
        nonlocal links
        while len(stack) > depth:
            e = stack[-1]
            if e.tag in BLOCK:
                if not stack[-2].boiler:
                    flush(e)
                blocky.pop()
            links -= e.tag == "a"
            opened[e.tag].pop()
            stack.pop()
            if (began := looking.pop(len(stack), None)) is not None and mains > began[2]:
                wrong.append((began[0], total - began[1]))

    def innermost(tags: tuple[str, ...], within: tuple[str, ...] = ()) -> int:
        """The depth of the innermost open element of tags that no open one of within is deeper than; 0 without."""
        found = 0
        for n in tags:
            if (depths := opened.get(n)) and depths[-1] > found:
                found = depths[-1]
        if found:
            for n in within:
                if (depths := opened.get(n)) and depths[-1] >= found:
                    return 0
        return found

    end = len(page)
    while at < end:
        m = scan.next(at)
        text = page[at:m[0] if m else end]
        if text:
            total += len(text.strip())
            if not stack[-1].boiler:
                pending.append(text)
                if links:
                    took += len(text)
        if m is None:
            break
        _, at, tag, attrs, closing = m
        if tag is None:
            if attrs and not stack[-1].boiler:  # of a CDATA section its text
                pending.append(entities.escape(attrs))
            continue
        if closing:
            if depth := innermost((tag,)):
                if tag in BLOCK or not blocky or blocky[-1] < depth:
                    close(depth)
            elif tag in ("p", "br"):
                flush(stack[-1])
            continue
        if tag == "br":
            if not stack[-1].boiler:
                pending.append(" ")
            continue
        if tag in ENDS_P and (depth := innermost(("p",), ("table", "button"))):
            close(depth)
        if tag in SIBLINGS and (depth := innermost(SIBLINGS[tag], ("ul", "ol", "dl", "table", "select"))):
            close(depth)
        step, boiler, looks = _described(tag, attrs)
        number += 1
        above = stack[-1]
        boiler = boiler and not (looks and number in cleared)
        if tag in BLOCK and not above.boiler:
            flush(above)
        mains += tag in ("h1", "main")
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            at = scan.raw_end(tag, at)
            continue
        path = above.path
        if tag in BLOCK:
            path = paths.get((above.path, step))
            if path is None:
                agrees = above.path.matched == above.path.depth < len(steps) and steps[above.path.depth] == step
                path = paths[above.path, step] = Path(above.path, step, agrees)
        opened.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocky.append(len(stack))
        if looks and number not in cleared:
            looking[len(stack)] = (number, total, mains - (tag in ("h1", "main")))
        stack.append(Element(tag, path, boiler or above.boiler, above, above.inside or bool(steps) and path.matched == path.depth == len(steps)))
        links += tag == "a"
    close(1)
    flush(root)
    if more := [n for n, held in wrong if 2 * held > total]:
        return walk(page, chosen, frozenset(more))
    return scores, blocks


def best_path(scores: dict[Path, float]) -> tuple[str, float] | None:
    """The path with the most, of equal ones a shallow one, then the first by name."""
    if not scores:
        return None
    most = max(scores.values())
    shallow = min(p.depth for p, v in scores.items() if v == most)
    return min(p.text() for p, v in scores.items() if v == most and p.depth == shallow), most


def extract(page: str, winner: str | None) -> str:
    """The main text of a page, given its host's winning path."""
    if not page:
        return ""
    if winner:
        scores, blocks = walk(page, winner)
        if blocks:
            return "\n".join(blocks)
    else:
        scores, _ = walk(page)
    own = best_path(scores)
    return "\n".join(walk(page, own[0])[1]) if own else ""


def host_of(url_col: str):
    return F.lower(F.coalesce(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, winner``: the path with the most votes of each host."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            rows = []
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if (best := best_path(walk(page or "")[0])) is not None:
                    rows.append((host, *best))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(("host", "path", "score"), map(list, zip(*rows, strict=True)), strict=True)))

    votes = pages.select(host_of(url_col).alias("host"), html_col).mapInArrow(vote, "host string, path string, score double")
    sums = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    return sums.groupBy("host").agg(F.max(F.struct("n", "score", "path"))["path"].alias("winner"))


def extract_pages(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", out_col: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """pages, without html, with the main text of each."""
    winners = saved(host_paths(pages, url_col=url_col, html_col=html_col), "host-paths")
    n_bytes = winners.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("winner") + 32), F.lit(0))).first()[0]
    keep = [c for c in pages.columns if c not in (html_col, out_col)]
    page, host, won = (unused(pages, n) for n in ("_html", "_host", "_winner"))
    given = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(html_col).alias(page), host_of(url_col).alias(host))
    told = winners.select(F.col("host").alias(host), F.col("winner").alias(won))
    given = given.join(F.broadcast(told) if n_bytes <= broadcast_bytes else told, host, "left").select(*(F.col(f"`{c}`") for c in keep), page, won)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-2]), f"`{out_col}` string"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            texts = [extract(h or "", w) for h, w in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(texts, pa.string())], names=[*keep, out_col])

    return given.mapInArrow(take, schema)
