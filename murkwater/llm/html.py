"""Main-text extraction by tag-path ratios.

A page is read as a sequence of blocks of text, each with the path of block elements from the root to it.
Text length and punctuation outside links are summed for each distinct path; their ratios to the path's
number of blocks are smoothed along the page among the blocks that one element holds, and fused with the
path's (or that element's) share of the page's text, and the share of it that is not in links. A block is content if its fused ratio reaches a threshold
relative to the page's highest; a heading goes with the block that it heads. Names of elements and
classes never decide by themselves: they are factors of the fused ratio (``WEIGHT``, ``MARKED``, ``NAMED``),
so an article inside a marked wrapper still has the highest ratio of its page, and an unmarked menu inside
an article has none. What is no text of a page (scripts, controls, hidden elements) is not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements without content, elements whose content is no markup, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is not read as text of a page.
UNREAD = frozenset("head button select option menu svg canvas object audio video label".split()) | RAW
#: Controls whose text is read where they stand inside a paragraph.
INLINE_CONTROLS = frozenset("label button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Lists, tables and quotes: what they hold is smoothed with the blocks around them.
WITHIN = frozenset("ul ol li dl dt dd table tbody thead tfoot tr td th caption figure figcaption blockquote".split())
#: Factors of elements that seldom or never hold an article.
WEIGHT = {"nav": 0.001, "footer": 0.001, "aside": 0.005, "dialog": 0.005, "header": 0.05, "form": 0.1, "fieldset": 0.1}
#: Words of a class, id or role, and the factor of each different one around a block.
MARKS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer gdpr masthead menu nav navbar navigation newsletter notice notices modal pagination popup promo related share sharing sidebar sponsored subscribe widget".split()
)
#: First and last words of a class that tell how a page is laid out, such as with-sidebar or comments-open.
LAYOUT = (frozenset("with without has no hide show".split()), frozenset("open closed on off enabled disabled".split()))
MARKED, LOOSELY_MARKED = 0.005, {"widget": 0.1, "share": 0.1, "related": 0.1}
#: The sum of fused ratios without which a page has no content if its best block is marked; an unmarked block of two characters has as much.
LEAST_MARKED = 2.0
#: The factor of blocks inside an article or main element against the page's highest ratio, and that of
#: marked blocks outside it on a page that has one.
NAMED, OUTSIDE = 20.0, 0.05
#: Characters and punctuation marks of a block from which on more says no more.
MOST_LENGTH, MOST_POINTS = 200.0, 8.0
#: How much of what an element holds at any depth counts for the share of a block right inside it.
NESTED = 0.5
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
_SPACE = re.compile(r"\s+")


def _evidence(tag: str, attributes: str) -> dict[str, float] | None:
    """Factors by name of an element; None if its content is not read."""
    if tag in UNREAD:
        return None
    said = {m[0].lower(): m[1] or m[2] or m[3] for m in reversed(_ATTRIBUTE.findall(attributes))} if attributes.strip(" /") else {}
    if "hidden" in said:
        return None
    found = {tag: WEIGHT[tag]} if tag in WEIGHT else {}
    if tag not in ("body", "html", "article", "main"):
        for value in ("class", "id", "role"):
            for name in said.get(value, "").lower().split():
                parts = re.findall(r"[a-z]+", name)
                if parts and parts[0] not in LAYOUT[0] and parts[-1] not in LAYOUT[1]:
                    found |= {x: LOOSELY_MARKED.get(x, MARKED) for x in (parts[0], parts[-1]) if x in MARKS}
    return found


@dataclass
class Block:
    """A block of text: block elements around it as (tag, number), factors by name, texts, and what they sum up to."""

    elements: tuple
    factors: dict
    texts: list[str] = field(default_factory=list)
    size: int = 0
    linked: int = 0
    links: set[int] = field(default_factory=set)
    points: int = 0

    def only_links(self) -> bool:
        """Whether it is a row of links, as menus are."""
        return not self.size and len(self.links) > 1


def _blocks(page: str) -> list[Block]:
    """Blocks of text in page order; blank ones are left out."""
    out: list[Block] = []
    path: list[tuple[str, int, bool, dict]] = []  # tag, number, whether it is unread, factors of all elements up to it
    unread = links = block = number = at = 0
    last_block = -1

    def text(chunk: str) -> None:
        nonlocal last_block
        if unread or not chunk:
            return
        blank = chunk.isspace()
        if block != last_block:
            if blank:
                return
            out.append(Block(tuple(x[:2] for x in path if x[0] in BLOCK), path[-1][3] if path else {}))
            last_block = block
        now = out[-1]
        chunk = entities.unescape(chunk)
        now.texts.append(chunk)
        if links:
            now.linked += len(chunk.strip())
            now.links.update(x[1] for x in path if x[0] == "a" and not blank)
        elif not blank:
            now.size += len(chunk.strip())
            now.points += len(_PUNCTUATION.findall(chunk))

    def close(k: int) -> None:
        nonlocal unread, links, block
        for t, _, u, _ in path[k:]:
            unread -= u
            links -= t == "a"
            block += t in BLOCK
        del path[k:]

    end, last = len(page), page.rfind(">")
    while at < end:
        m = _TOKEN.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(path) - 1, -1, -1):
                if path[k][0] == tag:
                    close(k)
                    break
            else:
                block += tag == "p"  # counts as an empty paragraph
            continue
        if tag in BLOCK:
            block += 1
            for k in range(len(path) - 1, -1, -1):  # a paragraph ends where a block starts
                if path[k][0] == "p":
                    close(k)
                    break
                if path[k][0] in BLOCK:
                    break
            for k in range(len(path) - 1, -1, -1):
                if tag in CLOSED_BY.get(path[k][0], ()):
                    close(k)
                    break
                if path[k][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if tag in VOID:
            if tag == "br":
                text(" ")
            continue
        if tag in RAW and not m[3].endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        number += 1
        spoken = tag in INLINE_CONTROLS and any(x[0] == "p" for x in path)
        found = _evidence("span" if spoken else tag, m[3])
        if found and tag != "form" and any(x[0] in ("article", "main") for x in path):
            found = {k: v for k, v in found.items() if k != "header"}  # headers of articles are their own
        factors = path[-1][3] if path else {}
        path.append((tag, number, found is None, factors | found if found else factors))
        unread += found is None
        links += tag == "a"
    return out


def _smoothed(x: np.ndarray, reach: int = 2) -> np.ndarray:
    """Weighted mean of each value and its neighbours; beyond the ends there is nothing."""
    weights = np.exp(-0.5 * np.arange(-reach, reach + 1) ** 2)
    sums, mass = np.convolve(x, weights), np.convolve(np.ones(len(x)), weights)
    return sums[reach : reach + len(x)] / mass[reach : reach + len(x)]


def _fused(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Each block's fused tag-path ratio, without and with what is said for elements named article or main."""
    parents = {e for b in blocks for e in b.elements[:-1]}
    paths, homes, units = [], [], []
    for i, b in enumerate(blocks):
        # text beside block elements stands in no block of its own
        elements = (*b.elements, ("", -i)) if b.elements and b.elements[-1] in parents else b.elements
        k = next((k for k in range(len(elements) - 2, -1, -1) if elements[k][0] not in WITHIN), -1)
        paths.append((tuple(t for t, _ in elements), tuple(sorted(b.factors))))
        homes.append(elements[: k + 1])
        units.append(elements[: k + 2] or (("", -i),))
    kinds = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    of = np.array([kinds[p] for p in paths])
    size, linked, points = (np.bincount(of, [getattr(b, k) for b in blocks]) for k in ("size", "linked", "points"))
    many = np.bincount(of)
    ratio, point = np.minimum(size / many, MOST_LENGTH)[of], np.minimum(points / many, MOST_POINTS)[of]
    share = size[of].astype(float)
    total: dict[tuple, int] = {}
    for b in blocks:
        for e in b.elements:
            total[e] = total.get(e, 0) + b.size
    held: dict[tuple, dict[tuple, list[int]]] = {}
    for i, (h, u) in enumerate(zip(homes, units, strict=True)):
        held.setdefault(h, {}).setdefault(u, []).append(i)
    for inside in held.values():
        runs = list(inside.values())
        for x in (ratio, point):
            for at, mean in zip(runs, _smoothed(np.array([x[at].mean() for at in runs])).tolist(), strict=True):
                x[at] = mean
        every = [i for at in runs for i in at]
        share[every] = np.maximum(share[every], sum(blocks[i].size for i in every))
    for i, h in enumerate(homes):  # elements that hold both the block and the rest of an article
        if h and (h[-1][0] not in ("body", "html") or h == blocks[i].elements):
            share[i] = max(share[i], NESTED * total[h[-1]])
    free = (size / np.maximum(size + linked, 1))[of] * np.array([not b.only_links() for b in blocks])
    fused = ratio * np.sqrt(1 + point) * share / max(share.max(), 1) * free
    named = np.array([any(t in ("article", "main") for t, _ in b.elements) for b in blocks])
    evidence = np.array([float(np.prod(list(b.factors.values()))) for b in blocks])
    if (fused[named & (evidence == 1)] > 0).any():
        evidence[~named & (evidence < 1)] *= OUTSIDE
    fused *= evidence
    after = None
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i].elements
        if not b or b[-1][0] not in HEADINGS:
            after = i
        elif after is not None:
            around = homes[i][:-1] if len(homes[i]) > 1 and homes[i][-2][0] not in ("body", "html") else homes[i]
            if blocks[after].elements[: len(around)] == around and homes[i]:
                fused[i] = max(fused[i], fused[after] * min(1.0, evidence[i] / evidence[after] if evidence[after] else 1.0))
    return fused, np.where(named, fused * NAMED, fused)


def main_text(page: str | None, threshold: float = 0.25) -> str:
    """The content blocks of a page joined by newlines; empty if it has no text but links and controls."""
    blocks = _blocks(page or "")
    if not blocks:
        return ""
    fused, favoured = _fused(blocks)
    top = fused.max()
    if blocks[int(fused.argmax())].factors and fused.sum() < LEAST_MARKED:
        return ""
    lines = (_SPACE.sub(" ", "".join(b.texts)).strip() for b, x in zip(blocks, favoured.tolist(), strict=True) if x > 0 and x >= threshold * top)
    return "\n".join(x for x in lines if x)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.schema.get_field_index("html")
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            texts = pa.array([main_text(x) for x in part.column(k).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(part.columns) if i != k], texts], [*[n for i, n in enumerate(batch.schema.names) if i != k], "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and main text of each row of ``pages`` (page_id, url, html).

    A null page, or one of links, controls and a few marked words alone, has an empty text. Pages are read
    whole, however long. Rows are independent, so repeated rows give repeated results; other columns of
    ``pages``, whatever their names, are left out. Lone surrogates can't occur; character references to them
    become U+FFFD as HTML has it.
    """
    rows = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
