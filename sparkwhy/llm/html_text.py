"""Main text of HTML pages by tag-path ratios."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches

_WORDS = str.split
# Fixed values of HTML: elements by how their content is read.
RAW = frozenset(_WORDS("script style textarea title xmp iframe noembed noframes"))
VOID = frozenset(_WORDS("area base br col embed hr img input link meta param source track wbr"))
INLINE = frozenset(
    _WORDS(
        "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong "
        "sub sup time tt u var"
    )
)
#: Elements that show no text of the page's own: markup, scripts, controls, embedded things.
HIDDEN = frozenset(
    _WORDS(
        "head button select option input textarea script style title noscript template svg math canvas object iframe audio video noembed noframes xmp"
    )
)
#: Elements that say themselves that they stand beside the main text.
BESIDE = frozenset(_WORDS("nav header footer aside menu dialog"))
#: Elements that stand inside a line of text and do not end its block.
_IN_LINE = INLINE | frozenset(_WORDS("script style template noscript svg math canvas object iframe audio video button select option input textarea img"))
#: Levels of open elements that are told apart.
DEEPEST = 512
#: Words in a class, id or role that name what is not main text.
CLUTTER_NAMES = frozenset(
    _WORDS(
        "ad ads adv advert adverts advertisement advertisements adbox adslot banner sponsor sponsored sponsors promo promos promotion promotions "
        "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc header masthead topbar footer colophon copyright sidebar "
        "sidebars aside widget widgets related recommended recommendations comment comments commentlist reply replies respond disqus discussion "
        "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing "
        "social sharebar form search searchform skip toolbar complementary contentinfo"
    )
)
#: Beginnings of such words that are never the beginning of another.
_CLUTTER_START = tuple(_WORDS("cookie advert sidebar newsletter breadcrumb sponsor banner popup navbar promo"))
#: Words that say nothing about what an element holds; beside any other word a name is not taken for clutter.
_NEUTRAL = frozenset(
    _WORDS(
        "site page global main top bottom left right upper lower first last box block bar wrap wrapper container section area list item items inner outer "
        "primary secondary body text title link links button buttons posts articles stories reader readers user users js x col row"
    )
)
#: Comment sections, which are often longer than the text they are about.
_COMMENTS = frozenset(_WORDS("comment comments commentlist reply replies respond disqus discussion"))
#: Kinds of elements that names or tags doubt: may hold the page's text after all; only where no article or main does; never.
_DOUBTED, _REPLIES, _NEVER = range(3)
#: Ends the paths of blocks in such elements.
CLUTTER = "!"
_LEAVES = frozenset(_WORDS("html body p li td h1 h2 h3"))
_CLOSED_BY: dict[str, frozenset[str]] = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)),
}
_LIST_EDGE = frozenset(("ul", "ol", "dl", "table", "select", "menu"))
# Quotes count after an equals sign alone. Nothing is matched twice, so odd tags cost no more than others.
_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>""",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s"'>]++)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_PUNCT = re.compile(r"[.,;:!?…。，、！？；：]")
_SPLIT = re.compile(r"[^a-z0-9]+")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    """Text of one block: the path of elements above it and what the ratios need."""

    __slots__ = ("parts", "path")

    def __init__(self, path: tuple[str, ...]):
        self.path, self.parts = path, []  # of a part: text, whether linked, number of the innermost element around it that names would skip


def blocks(html: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of each block with text that the page shows.

    A path names elements from the root to the block as tag, or tag.names where a class, id or role
    is given; article and main go by their tag alone, so that all articles share their paths. Of
    text in an element that says, or whose names say, that it stands beside the main text the path ends
    in ``CLUTTER``. Names say so unless the element is an article that is in no other one, or holds most of
    the unlinked text (four fifths, if an article or main has text outside it); where an article or main holds other text, elements beside it, comment sections and forms do at any length.
    End tags may be missing: a paragraph ends at the next block, a list item
    at the next item, and an end tag closes what is open inside its element.
    """
    out: list[Block] = []
    stack: list[tuple[str, str, bool, bool, int]] = []  # tag, name in the path, skipped, block, number if it is doubted
    now: Block | None = None
    skipped = links = articles = mains = 0
    doubted: list[tuple[int, int, bool]] = [(0, _DOUBTED, False)]  # of each element that tag or names doubt: the one around it, its kind, whether in an article or main
    around = 0  # the innermost open one; 0 is the page
    deep = [Counter()]  # open elements too deep for the stack, by tag: above level DEEPEST of it, and above each further one

    def add(text: str) -> None:
        nonlocal now
        if skipped or not text:
            return
        if now is None:
            now = Block(tuple(e[1] for e in stack[:DEEPEST] if e[3]))
            out.append(now)
        now.parts.append((text, links > 0, around))

    def pop() -> None:
        nonlocal skipped, links, articles, mains, around, now
        tag, _, skips, block, number = stack.pop()
        if len(stack) >= DEEPEST:
            deep.pop()
        else:
            deep[0].clear()
        skipped -= skips
        links -= tag == "a"
        articles -= tag == "article"
        mains -= tag == "main"
        if number:
            around = doubted[number][0]
        if block:
            now = None

    at, size = 0, len(html)
    while at < size:
        found = _TOKEN.search(html, at)
        if found is None:
            add(unescape(html[at:]))
            break
        if found.start() > at:
            add(unescape(html[at : found.start()]))
        at = found.end()
        tag = found["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if found["end"]:
            if tag not in _IN_LINE:
                now = None
            for k in range(len(stack) - 1, -1, -1):
                if k + 1 >= DEEPEST and deep[k + 1 - DEEPEST][tag]:
                    while len(stack) > k + 1:
                        pop()
                    deep[-1][tag] -= 1
                    break
                if stack[k][0] == tag:
                    while len(stack) > k:
                        pop()
                    break
                if tag in _IN_LINE and stack[k][3]:
                    break  # an inline end tag closes nothing beyond its block
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in _IN_LINE:
            now = None
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else size
            continue
        attrs = found["attrs"] or ""
        if tag not in _IN_LINE and not any(deep[-1].values()):
            _close(tag, stack, pop)
        given = _attributes(attrs) if attrs.strip(" /") else {}
        words = set(_SPLIT.split(" ".join(given[k] for k in ("class", "id", "role") if k in given).lower())) - {""}
        skips = tag in HIDDEN or "hidden" in given or _NO_DISPLAY.search(given.get("style", "")) is not None
        kind = None if skips else _kind(tag, given, articles)
        if attrs.endswith("/") and tag not in INLINE and tag in HIDDEN | BESIDE:
            continue
        if len(stack) >= DEEPEST and not skips and kind is None:
            deep[-1][tag] += 1
            continue  # as browsers do, elements nested deeper open no level of their own
        if kind is not None:
            doubted.append((around, kind, articles + mains > 0))
            around = len(doubted) - 1
        if len(stack) >= DEEPEST:
            deep.append(Counter())
        name = f"{tag}.{'.'.join(sorted(words))}" if words and tag not in ("article", "main") else tag
        stack.append((tag, name, skips, tag not in _IN_LINE, around if kind is not None else 0))
        skipped += skips
        links += tag == "a"
        articles += tag == "article"
        mains += tag == "main"
    stay = _holding_most(out, doubted)
    found_blocks = []
    for b in out:
        for path, here in ((b.path, True), ((*b.path, CLUTTER), False)):
            parts = [(text, linked) for text, linked, inside in b.parts if (inside in stay) == here]
            found_blocks.append((path, " ".join("".join(t for t, _ in parts).split()), sum(len(t) for t, linked in parts if linked)))
    return [x for x in found_blocks if x[1]]


def _kind(tag: str, given: dict[str, str], articles: int) -> int | None:
    """How an element's tag and names doubt that it is main text, if they do."""
    if tag in BESIDE or any(map(_clutter, given.get("role", "").split())):
        return _NEVER
    if tag == "form":
        return _REPLIES
    if tag in ("html", "body", "main") or (tag == "article" and not articles):
        return None
    found = [parts for name in f"{given.get('class', '')} {given.get('id', '')}".split() if (parts := _clutter(name))]
    if not found:
        return None
    return _DOUBTED if _COMMENTS.isdisjoint(w for parts in found for w in parts) else _REPLIES


def _clutter(name: str) -> list[str]:
    """The words of a class, id or role, neutral ones left out, if each of them names clutter; else none."""
    words = [w for w in map(str.lower, _NAME_PARTS.findall(name)) if w not in _NEUTRAL]
    return words if all(w in CLUTTER_NAMES or w.startswith(_CLUTTER_START) for w in words) else []


def _attributes(attrs: str) -> dict[str, str]:
    """Values by lower-case name; of repeated names the first counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTR.findall(attrs):
        found.setdefault(name.lower(), "".join(values))
    return found


def _holding_most(out: list[Block], doubted: list[tuple[int, int, bool]]) -> set[int]:
    """Numbers of the doubted elements whose text is main text after all, and 0."""
    if len(doubted) == 1:
        return {0}
    never = [False]
    for outer, kind, _ in doubted[1:]:
        never.append(never[outer] or kind == _NEVER)
    held = [0] * len(doubted)
    plain = False
    for b in out:
        for text, linked, inside in b.parts:
            size = 0 if linked or never[inside] else len(text) - text.count(" ")
            held[inside] += size
            plain = plain or bool(size and not inside and _home(b.path))
    for k in range(len(doubted) - 1, 0, -1):
        held[doubted[k][0]] += held[k]
    stay = {0}
    for k, (outer, kind, inside) in enumerate(doubted[1:], 1):
        most = 5 * held[k] > 4 * held[0] if plain else 2 * held[k] > held[0]
        if outer in stay and not never[k] and most and not (plain and (kind == _REPLIES or not inside)):
            stay.add(k)
    return stay


def _close(tag: str, stack: list, pop) -> None:
    """End what the start of a block ends by itself: an open paragraph, or the item before."""
    for k in range(len(stack) - 1, -1, -1):
        name = stack[k][0]
        if name == "p" or name in _CLOSED_BY.get(tag, ()):
            while len(stack) > k:
                pop()
            if name != "p":
                return
            continue
        if name in _LIST_EDGE or (name not in _IN_LINE and tag not in _CLOSED_BY):
            return


def path_scores(found: list[tuple[tuple[str, ...], str, int]], beside: float = 0.05, in_main: float = 0.6) -> dict[tuple[str, ...], float]:
    """Fused and smoothed ratio of each tag path.

    Text characters and punctuation marks are summed over all nodes of a path and divided by their
    number, characters inside links counting a fiftieth; the two ratios are fused as their geometric mean,
    punctuation counting from one on. A path is then smoothed with the highest ratio of its
    column, so that headings, short paragraphs and lists gain from the text they stand in: the articles, or main,
    or else the deepest element that holds nearly all text of high ratio. Paths in no column are smoothed
    with those of their parent. Where a page says by article or main elements where its text is, other
    paths count for the share ``beside``, and those in main beside articles for ``in_main``. ``CLUTTER`` has no ratio.
    """
    sums: dict[tuple[str, ...], list[float]] = {}
    for path, text, linked in found:
        s = sums.setdefault(path, [0, 0, 0])
        s[0] += max(0, len(text) - linked) + min(linked, len(text)) / 50
        s[1] += len(_PUNCT.findall(text))
        s[2] += 1
    fused = {p: 0.0 if p[-1:] == (CLUTTER,) else math.sqrt((chars / n) * (1 + marks / n)) for p, (chars, marks, n) in sums.items()}
    home = {p: _home(p) if fused[p] else "" for p in fused}
    held = Counter()
    for p, h in home.items():
        held[h] += sums[p][0]
    column = {p for p, h in home.items() if h and (h == "article" or held["main"] > held["article"])}
    told = bool(column)
    if not told:
        root = _column({p: sums[p][0] for p, v in fused.items() if v >= 0.25 * max(fused.values(), default=0)})
        column = {p for p in fused if root and p[: len(root)] == root}
    top = max((fused[p] for p in column), default=0.0)
    near: dict[tuple[str, ...], float] = {}
    for p, v in fused.items():
        if p not in column:
            near[p[:-1]] = max(v, near.get(p[:-1], 0.0))
    scores = {}
    for p, v in fused.items():
        smooth = 0.5 * v + 0.5 * (top if p in column else near[p[:-1]])
        share = 1.0 if p in column or not told else in_main if home[p] else beside
        scores[p] = share * smooth if v else 0.0
    return scores


def _home(path: tuple[str, ...]) -> str:
    """article or main, if the path lies in one; article if in both."""
    return "article" if "article" in path else "main" if "main" in path else ""


def _column(weight: dict[tuple[str, ...], float]) -> tuple[str, ...]:
    """The deepest element, but for single blocks and the body, that holds four fifths of the weight; empty if none does."""
    sums: Counter = Counter()
    for path, w in weight.items():
        for k in range(1, len(path) + 1):
            sums[path[:k]] += w
    wide = [p for p, w in sums.items() if w >= 0.8 * sum(weight.values()) and p[-1].split(".")[0] not in _LEAVES]
    return max(wide, key=len, default=())


def main_text(html: str | None, share: float = 0.25) -> str:
    """Blocks of the main text, one per line; empty if there are none.

    Blocks are main text if the score of their tag path reaches ``share`` of the page's highest.
    """
    found = blocks(html) if html else []
    scores = path_scores(found)
    least = share * max(scores.values(), default=0.0)
    return "\n".join(text for path, text, _ in found if scores[path] >= least and scores[path] > 0)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.25) -> DataFrame:
    """Main text of every page: id, url, text, n_chars (code points), one row per input row.

    A null or empty html, and a page without main text, give an empty text. Null ids and
    urls stay null, repeated rows stay repeated, an empty table gives an empty result,
    other columns are ignored. A page is worked on alone and whole.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, share) for h in batch.column(2).to_pylist()]
            made = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["id", "url", "text", "n_chars"])

    source = pick(pages, id_col, url_col, html_col).select(F.col(id_col).cast("long"), url_col, html_col)
    return source.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
