"""Main text of web pages by tag-path ratios.

Every text run of a page belongs to a root-to-leaf path of block elements (tags with their classes; inline elements only if they have a class, an id or a role).
Per path the text length, the punctuation and the number of nodes are added up over the page, which gives two
ratios, characters a node and marks a node. Both are smoothed along the path: a path's ratio is averaged with those of its prefixes
(every prefix has the length-weighted mean of the paths below it), each step up counting less. The smoothed
ratios are fused, length times one plus punctuation. A node is kept if its path's fused ratio, lowered
by the share of link text, is at least `threshold` times that of the content area: the deepest element
that holds most text of the paths whose ratio passes half of the mean (text in an article or main element counts four times).

So headings and short lists of an article live on the ratio of the article's prefix, and deep branches of short texts in it go. What
lies outside the area shares no prefix with it but those above it, which count little (`above`), and has to come near the area's
ratio on its own (`outside`); headings and paragraphs that stand directly in an element around an unmarked area count as within it
(in the body: headings). Names and tags of menus, forms, footers and the like do not decide: such an
element takes over little of its prefixes' ratio (`cut`), and stays if its own is high enough. Outside the area such a name also weighs
as much as `evidence` characters of the area: beside an article of a line or two the ratios say little. Only for text that is prose too
(comments, side columns, cookie notices) the ratio can't tell, and the name lowers it (`prose`).

Defined cases: null or empty html, or html without text, gives an empty string; several rows with
the same page are extracted independently; a page of any length and any depth is parsed whole, in
time proportional to its length; unclosed or misnested tags are closed as a browser would (a new
paragraph ends an open one; a comment, a script or a tag that never ends takes up the rest); other
columns of the table are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML.
RAW = "script style noscript template textarea title svg iframe".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul"
).split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
BOILERPLATE_TAGS = "nav header footer form menu button select dialog head".split()
#: Words that, as a class, an id or a role, say that an element is usually no content.
BOILERPLATE_NAMES = (
    "ad ads advert advertisement adverts advertising banner menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
    "share sharing social notice notices popup modal "
    "subscribe subscription login signup search form pagination pager widget toolbar contentinfo"
).split()
#: The same of text that reads like an article: only the name tells.
PROSE_TAGS = "aside".split()
PROSE_NAMES = (
    "sponsor sponsored promo promotion sidebar aside complementary related recommended comment comments commentlist disqus reply replies respond "
    "cookie cookies consent gdpr newsletter"
).split()
#: Opening tags that end open elements: which ones, and the containers beyond which nothing is ended.
ENDS = {
    "li": ("li p", "ul ol menu"),
    "dt": ("dt dd p", "dl"),
    "dd": ("dt dd p", "dl"),
    "tr": ("tr td th p", "table tbody thead tfoot"),
    "td": ("td th p", "tr table"),
    "th": ("td th p", "tr table"),
    "option": ("option", "select"),
}

_BLOCKS, _VOID, _RAW, _BAD_TAGS, _BAD_NAMES, _PROSE_TAGS, _PROSE_NAMES, _HEADINGS = map(frozenset, (BLOCKS, VOID, RAW, BOILERPLATE_TAGS, BOILERPLATE_NAMES, PROSE_TAGS, PROSE_NAMES, HEADINGS))
_ENDS = {tag: (a.split(), b.split()) for tag, (a, b) in ENDS.items()}
_HOLDERS = frozenset("article body center div main section table #".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_SKIP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"([^\s>/=]+|=[^\s>/=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I | re.A) for tag in RAW}
_PARTS = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…](?=\s|$)|[。，、！？]")


@dataclass(frozen=True)
class Ratios:
    """Parameters: fused ratio that keeps a node, relative to the area's; share of the content paths' text that the area holds at least;
    weight of a prefix a step further up, of prefixes above the area and of those beyond an element named as
    boilerplate; factor of what lies outside the area, and characters of the area that a name outside weighs as much as; factors of link text and of named prose."""

    threshold: float = 0.1
    share: float = 0.5
    step: float = 0.9
    above: float = 0.05
    cut: float = 0.03
    cut_part: float = 0.7
    outside: float = 0.105
    evidence: float = 50.0
    links: float = 0.7
    prose: float = 0.05


class Page:
    """Elements in page order (tag, parent, path, whether a boilerplate tag, names), and text runs (block, element, text, in a link)."""

    def __init__(self):
        self.tags, self.parents, self.paths, self.names = ["#"], [-1], [0], [()]
        self.path_of: dict[tuple[int, str], int] = {}
        self.above = [0]  # path -> the path without its last step
        self.runs: list[tuple[int, int, str, bool]] = []
        self.blocks = 0


def _tags(page: str) -> Iterator[tuple[str, str, str, str, bool]]:
    """(kind, tag, classes, text, self-closed) for the page's tags and texts, each character looked at a bounded number of times."""
    at, size, last = 0, len(page), {'"': page.rfind('"'), "'": page.rfind("'")}
    while at < size:
        less = page.find("<", at)
        if less < 0:
            less = size
        if less > at:
            yield "text", "", "", page[at:less], False
            at = less
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        m = _TAG.match(page, at)
        if not m:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            else:
                yield "text", "", "", "<", False
                at += 1
            continue
        tag, at, names, closed = m[2].lower(), m.end(), [], False
        while True:
            skipped = _SKIP.match(page, at)
            closed = closed or skipped[0].endswith("/")
            a = _ATTRIBUTE.match(page, skipped.end())
            if not a:
                at = skipped.end()
                break
            at, value, closed = a.end(), "", False
            if a[2]:
                quote = page[at : at + 1]
                if quote in last and at < last[quote]:
                    end = page.find(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    b = _BARE.match(page, at)
                    value, at = b[0], b.end()
                    closed = value.endswith("/") and tag in _RAW
            if a[1].lower() in ("class", "id", "role"):
                names.append(value)
        if at >= size:
            return  # a tag that never ends
        at += 1
        if m[1]:
            yield "close", tag, "", "", False
            continue
        if tag in _RAW:
            if not (closed and tag == "svg"):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else size
            continue
        yield "open", tag, " ".join(names).lower(), "", closed


def parse(html: str) -> Page:
    """The page's elements and text runs; every step takes constant time on average."""
    page = Page()
    stack, block_at, open_at = [0], [0], defaultdict(list)  # element; position of the nearest block; positions by tag
    block, fresh = 0, True

    def shut(depth: int) -> None:
        while len(stack) > depth:
            open_at[page.tags[stack.pop()]].pop()
            block_at.pop()

    for kind, tag, names, text, closed in _tags(html):
        if kind == "text":
            if fresh:
                page.blocks, fresh = page.blocks + 1, False
            page.runs.append((page.blocks - 1, stack[-1], text, bool(open_at["a"])))
            continue
        if tag in _VOID:
            if tag == "br" and not fresh:
                page.runs.append((page.blocks - 1, stack[-1], " ", False))
            elif tag == "hr":
                fresh = True
            continue
        is_block = tag in _BLOCKS
        fresh |= is_block
        if kind == "close":
            if open_at[tag] and (is_block or open_at[tag][-1] > block_at[-1]):
                shut(open_at[tag][-1])
            continue
        if tag in _ENDS:
            ends, holds = (max((open_at[t][-1] for t in some if open_at[t]), default=-1) for some in _ENDS[tag])
            while ends > holds:
                shut(ends)
                ends = max((open_at[t][-1] for t in _ENDS[tag][0] if open_at[t]), default=-1)
        elif is_block and page.tags[stack[block_at[-1]]] == "p":
            shut(block_at[-1])
        words = tuple(names.split())
        step = ".".join((tag, *sorted({re.sub(r"\d+", "", w) for w in words}))) if is_block or words else ""
        above = page.paths[stack[-1]]
        path = page.path_of.setdefault((above, step), len(page.path_of) + 1) if step else above
        if path == len(page.above):
            page.above.append(above)
        if closed and not is_block:
            continue
        page.tags.append(tag)
        page.parents.append(stack[-1])
        page.paths.append(path)
        page.names.append(words)
        open_at[tag].append(len(stack))
        block_at.append(len(stack) if is_block else block_at[-1])
        stack.append(len(page.tags) - 1)
    return page


@lru_cache(4096)
def _kinds(tag: str, names: tuple[str, ...], how: Ratios) -> tuple[float, float]:
    """What an element's tag and names say: how much it takes over from its prefixes, and the factor of its own ratio."""
    if tag in ("html", "body", "article", "main"):
        return 1.0, 1.0
    cut, factor = how.cut if tag in _BAD_TAGS else 1.0, how.prose if tag in _PROSE_TAGS else 1.0
    for name in names:
        parts = _PARTS.findall(name)
        if not parts or (len(parts) > 1 and parts[0] in ("has", "is", "no", "not", "with", "without")):
            continue
        if len(parts) > 1 and not _PROSE_NAMES.isdisjoint(parts) and (parts[0] in _PROSE_NAMES or parts[-1] in _PROSE_NAMES or parts[-1] == "list") or name in _PROSE_NAMES:
            factor = min(factor, how.prose)
        elif name in _BAD_NAMES or parts[-1] in _BAD_NAMES:
            cut = min(cut, how.cut)
        elif not _BAD_NAMES.isdisjoint(parts):
            cut = min(cut, how.cut_part)
    return cut, factor


def path_ratios(stats: dict[int, list[float]], above: list[int]) -> list[tuple[float, float]]:
    """(characters a node, marks a node) of every path and prefix: a path with text has its own, a prefix without text the length-weighted
    mean of the paths below it."""
    return [(x / w, y / w) if w else (0.0, 0.0) for w, x, y in _means(stats, above)]


def _means(stats: dict[int, list[float]], above: list[int]) -> list[list[float]]:
    sums = [[0.0, 0.0, 0.0] for _ in above]
    for path, (length, marks, nodes, _) in stats.items():
        sums[path] = [length, length * length / nodes, length * marks / nodes]
    for path in range(len(above) - 1, 0, -1):  # a prefix has a smaller number than what lies below it
        up, own = sums[above[path]], sums[path]
        for i in range(3):
            up[i] += own[i]
    return sums


def fuse(x: float, y: float) -> float:
    """Length ratio times one plus the punctuation ratio."""
    return x * (1 + y)


def _table(page: Page, sizes: list[tuple[int, int]], paths: list[int]) -> dict[int, list[float]]:
    """Path -> characters, marks, nodes and characters in links, in the order of first occurrence."""
    stats: dict[int, list[float]] = {}
    seen = set()
    for (block, element, _, link), (size, marks) in zip(page.runs, sizes):
        if size:
            path = paths[element]
            x = stats.setdefault(path, [0, 0, 0, 0])
            x[0] += size
            x[1] += marks
            x[2] += (path, block) not in seen
            x[3] += size * link
            seen.add((path, block))
    return stats


def extract(html: str | None, how: Ratios = Ratios()) -> str:
    """The main text of one page (see the module's text)."""
    page = parse(html or "")
    clean = [" ".join(entities.unescape(text).split()) for _, _, text, _ in page.runs]
    sizes = [(len(text), len(_PUNCTUATION.findall(text))) for text in clean]
    stats = _table(page, sizes, page.paths)
    if not stats:
        return ""
    ratios = path_ratios(stats, page.above)
    plain = {path: fuse(length / nodes, marks / nodes) for path, (length, marks, nodes, _) in stats.items()}
    n = len(page.tags)
    cuts, factors, depth, inside = [1.0] * n, [1.0] * n, [0] * n, [False] * n
    for e in range(1, n):
        up = page.parents[e]
        depth[e] = depth[up] + 1
        inside[e] = inside[up] or page.tags[e] in ("article", "main")
        cuts[e], factors[e] = _kinds(page.tags[e], page.names[e], how)
        if inside[up] and page.tags[e] == "header":
            cuts[e] = 1.0  # an article's own header holds its title

    # The content paths' text by element, from the leaves up; the area is the deepest element with most of it.
    kept = [1.0] * n
    for e in range(1, n):
        kept[e] = max(kept[page.parents[e]] * factors[e] * (0.5 if cuts[e] == how.cut else 1), 1e-9)
    used = [(e, text) for (_, e, _, _), text in zip(page.runs, clean) if text]
    told = [plain[page.paths[e]] * kept[e] * (4 if inside[e] else 1) for e, _ in used]
    mean = sum(told) / len(told)
    mass, weight, xs, ys = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    for (e, text), x in zip(used, told):
        if x >= mean / 2:
            length, marks, nodes, _ = stats[page.paths[e]]
            mass[e] += len(text) * (4 if inside[e] else 1)
            weight[e] += len(text)
            xs[e] += len(text) * length / nodes
            ys[e] += len(text) * marks / nodes
    for e in range(n - 1, 0, -1):
        for sums in (mass, weight, xs, ys):
            sums[page.parents[e]] += sums[e]
    area = max((e for e in range(n) if mass[e] > how.share * mass[0]), key=lambda e: (depth[e], -e))
    up = area
    while page.tags[up] not in ("article", "main") and page.parents[up] >= 0:
        up = page.parents[up]
    area = up if page.tags[up] in ("article", "main") else area
    while page.tags[area] not in _HOLDERS:
        area = page.parents[area]
    x_area, y_area = xs[area] / weight[area], ys[area] / weight[area]
    level = fuse(x_area, y_area)

    # From the root down: sums of the prefixes' ratios as seen from an element, and what names say since the branch left the area's.
    on, within = [False] * n, [False] * n
    up = area
    while up >= 0:
        on[up] = True
        up = page.parents[up]
    sums, factor = [(0.0, 0.0, 0.0)] * n, [1.0] * n
    marked = page.tags[area] in ("article", "main")
    named = weight[area] / (weight[area] + how.evidence)
    for e in range(1, n):
        up = page.parents[e]
        lead = page.tags[e] in _HEADINGS or (page.tags[e] == "p" and page.tags[up] not in ("body", "html", "#"))
        within[e] = within[up] or up == area or (on[up] and not marked and lead)
        if not on[e]:
            factor[e] = max(factor[up] * factors[e] * (named if cuts[e] == how.cut and not within[e] else 1), 1e-9)
        w, x, y = sums[up]
        if page.paths[up] != page.paths[e]:
            px, py = (x_area, y_area) if up == area else ratios[page.paths[up]]
            w, x, y = w + 1, x + min(px, x_area), y + min(py, y_area)
            c = how.step * (1 if on[e] else cuts[e]) * (how.above if on[up] and up != area and not within[e] else 1)
            w, x, y = w * c, x * c, y * c
        sums[e] = (w, x, y)
    # A path that occurs on both sides of the area's border has two rows in the table.
    sided = [path if within[e] or e == area else -path for e, path in enumerate(page.paths)]
    stats = _table(page, sizes, sided)
    out, last = [], -1
    for (block, e, text, _), words in zip(page.runs, clean):
        if words:
            length, marks, nodes, linked = stats[sided[e]]
            w, x, y = sums[e]
            ratio = fuse((min(length / nodes, x_area) + x) / (1 + w), (min(marks / nodes, y_area) + y) / (1 + w)) if e != area else level
            ratio *= factor[e] * (1 - how.links * linked / length) * (1 if within[e] or e == area else how.outside)
            if ratio < how.threshold * level:
                continue
        if block != last:
            out.append([])
            last = block
        out[-1].append(text)
    return "\n".join(x for x in (" ".join(entities.unescape("".join(runs)).split()) for runs in out) if x)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", how: Ratios = Ratios()) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. No shuffle: each page is parsed where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), how) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
