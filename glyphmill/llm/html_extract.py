"""Operator 7: main text of HTML pages by two-pass block rules.

A tokenizer cuts a page into blocks at block-level tags and keeps, for each,
its characters, those inside links, its words and stop words, and whether it
stands in a part of the page that is never main text (navigation, header,
footer, sidebar, form, notice, advert, comments).

Pass 1 decides each block on its own.  Such parts, and blocks dense in links,
are boilerplate; long blocks dense in stop words are text; long blocks nearly
without stop words are boilerplate; short blocks stay open, and so do middling
ones, which lean to what they hold.  Pass 2 gives an open block the label of
the nearest decided neighbours: where both sides agree, theirs; where they
differ, that of the closer one, text on a tie inside an article.

Class, id and role names mark boilerplate where a name is a mark or a compound
of one (``site-footer``); names that tell a state (``no-sidebar``,
``header-image``, ``share-enabled``) don't.  Compounds with a word that is no mark
(``share-price``, ``social-history``, ``post-header``) are weak: inside an article,
blocks dense in stop words are text for all that, and headings stay open.  Where
marks would leave a page without any text, only those of comments are believed.

A page that holds hardly any of the stop words is in another language: there,
length and link density decide alone, and a character of a script without spaces
counts as three.

Only block-level elements end a block: images, formulas, buttons, scripts and
unknown elements inside a paragraph leave it whole, unless a name marks them.

Scripts, styles, comments and other unseen elements never reach a block.
Character references are decoded, white space inside a block becomes one
space, ends are trimmed, and blocks join in page order by one newline.

Defined cases: null html counts as empty, and a page without main text gives
an empty string with n_chars 0; broken or unclosed markup is read as far as it
goes; very long pages are read whole; a tie between neighbours goes by the
article; repeated rows and null ids are all kept; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import bounded_batches, slices

#: Frequent function words of the languages at hand.
STOP_WORDS = frozenset(
    """
    the of and to in a is that for it on with as was are be this by from at or an not have has had but they you he she we
    i his her its their our your which who what when where will would can could if so no all there been were one do more
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie
    nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man ich
    le la les de des du un une et en que qui dans pour pas sur au aux par plus ce il elle se sa son ses est sont avec ne
    mais ou nous vous ils elles leur cette ces comme tout été était si même sans je on y à d l
    el los las y del se por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin
    sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto
    """.split()
)

#: Elements whose content is never seen.
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video map select textarea button".split())
#: Elements that hold boilerplate.
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
#: Elements that only dress up words inside a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block.
BLOCK_LEVEL = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role names that mark readers' comments, and other boilerplate.
COMMENTS = r"comments?|disqus|replies|reply"
OTHERS = (
    r"ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|related|recommend\w*|"
    r"cookies?|consent|notice|gdpr|newsletter|subscribe|signup|login|search|share|sharing|social|popup|modal|overlay|toolbar|pagination|pager|copyright|legal|complementary|contentinfo"
)
COMMENT_MARKS, OTHER_MARKS = (re.compile(rf"(?:^|[_-])(?:{words})(?:$|[_-])", re.I) for words in (COMMENTS, OTHERS))
#: Names that tell a state of an element and not what it is.
STATES = re.compile(r"(?:no|not|non|has|is|with|without|hide|show)[_-]|.*[_-](?:enabled|disabled|image|img|visible|hidden|open|closed|on|off|left-out|free|ready|loaded)$", re.I)
#: An attribute: its name, and its value in double quotes, single quotes or none.  A quote opens a value right after ``=`` only.
_VALUE = r"""(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>"'][^\s>]*))?)?"""
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)" + _VALUE)
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][\w:-]*)((?:[\s/]+|[^\s/>][^\s/>=]*" + re.sub(r"(?<!\\)\((?!\?)", "(?:", _VALUE) + r")*+)(?:>|\Z)|[^<]+|<",
    re.S,
)
WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: Thresholds: characters of short and long blocks, densities of links and stop words.
SHORT, LONG, LINKS, STOPS_LOW, STOPS_HIGH = 70, 200, 0.35, 0.12, 0.2
#: Share of stop words of a page under which its language is another one.
FOREIGN = 0.01
#: Characters of scripts without spaces.
DENSE = re.compile("[\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")

TEXT, BAD, OPEN = "text", "bad", "open"


#: What an element is by its tag and attributes: boilerplate for sure, of comments, by another mark, by a weak one, or nothing of that kind.
SURE, COMMENT, MARKED, WEAK, PLAIN = "sure", "comment", "marked", "weak", "plain"
_MARK = re.compile(rf"(?:{COMMENTS}|{OTHERS}|site|page|top|bottom|main|global|left|right|box|bar|block|list|links?|items?|container|wrapper|area|section|\d+)\Z", re.I)


def _weak(name: str) -> bool:
    """Whether a compound has a word that neither is a mark nor says where or how one stands."""
    return not all(_MARK.match(part) for part in re.split("[_-]+", name) if part)


@lru_cache(1 << 14)
def kind_of(name: str, attributes: str) -> str:
    if name in BOILERPLATE:
        return SURE
    if not attributes or name in ("body", "html"):
        return PLAIN
    kind = PLAIN
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and NO_DISPLAY.search(value):
            return SURE
        if key in ("class", "id", "role"):
            names = [x for x in value.split() if not STATES.match(x)]
            if any(map(COMMENT_MARKS.search, names)):
                kind = COMMENT
            elif kind in (PLAIN, WEAK) and (marks := [x for x in names if OTHER_MARKS.search(x)]):
                kind = WEAK if all(map(_weak, marks)) else MARKED
    return kind


class Block:
    __slots__ = ("parts", "linked", "bad", "marked", "weak", "article", "heading")

    def __init__(self, bad: bool, marked: bool, weak: bool, article: bool, heading: bool):
        self.parts, self.linked, self.bad, self.marked, self.weak, self.article, self.heading = [], 0, bad, marked, weak, article, heading


@cache
def _closing(name: str) -> re.Pattern:
    return re.compile(f"</{name}", re.I)


_BODY = re.compile("<body", re.I)


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with unseen elements left out."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool]] = []  # element, what it is, whether it is an article
    held = dict.fromkeys((SURE, COMMENT, MARKED, WEAK, PLAIN, "article", "heading"), 0)  # open elements of each kind
    opened: dict[str, int] = {}  # and by name
    links, current, skip_to = 0, None, 0

    def close() -> None:
        tag, kind, is_article = stack.pop()
        opened[tag] -= 1
        held[kind] -= 1
        held["article"] -= is_article
        held["heading"] -= tag in HEADINGS

    for m in TOKENS.finditer(page):
        if m.start() < skip_to:
            continue
        name = m[2]
        if name is None:
            piece = m[0]
            if piece[0] == "<" and len(piece) > 1:
                continue
            if current is None:
                if not piece.strip():
                    continue
                current = Block(held[SURE] + held[COMMENT] > 0, held[MARKED] + held[WEAK] > 0, not held[MARKED], held["article"] > 0, held["heading"] > 0)
                out.append(current)
            current.parts.append(piece)
            if links:
                current.linked += len(piece.strip())
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if m[1] else 1))
            continue
        level = name in BLOCK_LEVEL
        if level:
            current = None
        if name in UNSEEN:
            if not m[1] and not m[3].endswith("/"):
                end = _closing(name).search(page, m.end())
                # an element that never ends hides the rest, but a head ends where the body starts
                if end is None and name == "head":
                    end = _BODY.search(page, m.end())
                    skip_to = end.start() if end else m.end()
                else:
                    skip_to = end.start() if end else len(page)
            continue
        if name in VOID:
            continue
        if level:
            links = 0
        if m[1]:
            if opened.get(name):
                while stack[-1][0] != name:
                    current = current if stack[-1][1] == PLAIN else None
                    close()
                current = current if stack[-1][1] == PLAIN else None
                close()
            continue
        if name in ("p", "li") and stack and stack[-1][0] == name:  # such an element ends where the next one starts
            close()
        is_article = name in ("article", "main")
        kind = kind_of(name, m[3])
        if is_article and kind in (MARKED, WEAK) or name == "header" and held["article"] and not any(held[k] for k in (SURE, COMMENT, MARKED, WEAK)):
            kind = PLAIN  # a header inside an article holds its title
        if kind != PLAIN:
            current = None
        elif not level and m[3].endswith("/"):
            continue
        stack.append((name, kind, is_article))
        opened[name] = opened.get(name, 0) + 1
        held[kind] += 1
        held["article"] += is_article
        held["heading"] += name in HEADINGS
    return out


def stop_words(text: str) -> tuple[int, int]:
    """Stop words and all words of a text, where a character of a script without spaces is a word."""
    words = WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words) + (0 if text.isascii() else len(DENSE.findall(text)))


def first_pass(block: Block, text: str, marks: bool = True, foreign: bool = False, counts: tuple[int, int] | None = None) -> str:
    """Label of a block by itself; ``marks``: whether names of classes count; ``foreign``: whether stop words don't; ``counts``: what ``stop_words`` gives, if it is known."""
    if block.bad:
        return BAD
    n = len(text)
    if block.linked > LINKS * n:
        return BAD
    if not text.isascii():
        n += 2 * len(DENSE.findall(text))
    if marks and block.marked:
        if not (block.weak and block.article):
            return BAD
        if n < SHORT:
            return OPEN if block.heading else BAD
        if foreign:
            return TEXT if n >= LONG else BAD
        stops, words = counts or stop_words(text)
        return TEXT if words and stops / words >= STOPS_LOW else BAD
    if n < SHORT:
        return OPEN
    if foreign:
        return TEXT if n >= LONG or block.article else OPEN
    stops, words = counts or stop_words(text)
    density = stops / words if words else 0.0
    if density >= STOPS_HIGH or density >= STOPS_LOW and (n >= LONG or block.article):
        return TEXT
    if n >= LONG and density < STOPS_LOW and not block.article:
        return BAD
    return OPEN


def second_pass(found: list[Block], labels: list[str]) -> list[str]:
    """Open blocks inherit from their nearest decided neighbours; without any, an article's are text."""
    n = len(labels)
    before, after = [(None, 0)] * n, [(None, 0)] * n
    last = None
    for i in range(n):
        before[i] = (last, i)
        if labels[i] != OPEN:
            last = i
    last = None
    for i in range(n - 1, -1, -1):
        after[i] = (last, i)
        if labels[i] != OPEN:
            last = i
    out = list(labels)
    for i in range(n):
        if labels[i] != OPEN:
            continue
        p, q = before[i][0], after[i][0]
        # a neighbour on the other side of an article's edge doesn't speak for this block
        p, q = (k if k is not None and found[k].article == found[i].article else None for k in (p, q))
        if p is None and q is None:
            out[i] = TEXT if found[i].article else BAD
        elif p is None or q is None:
            out[i] = labels[q if p is None else p]
        elif labels[p] == labels[q]:
            out[i] = labels[p]
        elif found[i].heading:
            out[i] = labels[q]  # a heading belongs to what it heads
        elif i - p == q - i:
            out[i] = TEXT if found[i].article else BAD
        else:
            out[i] = labels[p if i - p < q - i else q]
    return out


def main_text(page: str | None) -> str:
    """Main text of one page."""
    kept, texts = [], []
    for block in blocks(page or ""):
        text = " ".join(entities.unescape("".join(block.parts)).split())
        if text:
            kept.append(block)
            texts.append(text)
    counts = [stop_words(t) for t in texts]
    foreign = sum(n for n, _ in counts) < FOREIGN * sum(n for _, n in counts)
    for marks in (True, False):
        labels = second_pass(kept, [first_pass(b, t, marks, foreign, c) for b, t, c in zip(kept, texts, counts)])
        if TEXT in labels or not any(b.marked for b in kept):
            break
    return "\n".join(t for t, label in zip(texts, labels) if label == TEXT)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars) of every page; no shuffle."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in slices(batches, "html"):
            texts = [main_text(x) for x in raw.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
