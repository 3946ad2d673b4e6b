"""Operator 3: main-text extraction from HTML by two-pass block rules.

The markup is cut into blocks. The first pass classifies each block on its own by
stop-word density, length and link density; what is no running text by its element
(navigation, footers, forms and the like) is never content. Short blocks and
blocks of few stop words stay undecided. In the second pass an undecided block
takes the label of its nearest decided neighbours; inside an article element only
neighbours of the same article count, so that a headline isn't drawn to the
advert before it.

Class and id names are only a hint: what they mark (sidebars, comments, notices)
is left out as long as the density rule finds the text elsewhere. A page whose
text all lies below marked elements had a layout that was named after one of its
parts, and the mark of the element around that text is dropped.

Reader comments need no class name to be known: a heading that only names or counts
them takes what follows it in its element, up to the next heading of its rank; two or
more like elements at the end of their parent that each begin with a line such as a
person's name or a time are posts; and text behind a page's only article is none of it.

Every scan is linear in the page. Texts pass through the tasks page by page; a
page is bounded by its own size.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH_LOW = 70
LENGTH_HIGH = 200
STOP_LOW = 0.10
STOP_HIGH = 0.20
LINKS_HIGH = 0.5

#: Common function words of the languages of the corpus.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be by at this from or an have not "
    "le la les de des du et un une en est que qui dans pour pas sur au avec par il ne se ce "
    "der die das und ist ein eine zu den dem von mit auf für nicht sich des im auch es als an "
    "el los las y del una con para por su al lo como más o pero sus".split()
)

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article text wherever they stand, and those whose text isn't text at all.
OUTSIDE = frozenset("head nav footer aside form button select textarea label dialog menu noscript template iframe object svg canvas audio video map".split())
RAW = frozenset("script style".split())
ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar form".split())
#: Words of class and id attributes that declare the same.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion sidebar rail menu nav navbar navigation "
    "breadcrumb breadcrumbs toolbar masthead footer cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended comment comments commentlist disqus reply replies respond widget pagination pager copyright".split()
)

#: Class names that begin so speak of what a layout has or lacks, not of what the element is.
MODIFIERS = frozenset("has with no not without".split())

HEADINGS = frozenset("h2 h3 h4 h5 h6 legend summary".split())
#: A heading that says nothing but that comments follow, or how many. Words for comments in the languages of the corpus.
_COMMENTS = re.compile(
    r"(?:\d+ |all |reader |readers' |user |leave an? |add an? |post an? |join the |alle |todos los |tous les |les )*"
    r"(?:comments?|repl(?:y|ies)|responses?|discussion|kommentare?|antworten|leserkommentare|diskussion|commentaires?|réponses?|réactions|comentarios?|respuestas?|opiniones)"
    r"(?: (?:below|from readers|of readers|des lecteurs|de los lectores|der leser))?(?: ?[(\[]?\d+[)\]]?)?[:.!]?",
    re.I,
)
#: A line that begins a post: up to four capitalised words, or a time or date, with nothing of a sentence.
_NAMED = re.compile(r"(?:[^\W\d_a-zß-ÿ][\w'’.-]*+,? ?){1,4}(?:(?:wrote|says|said|schrieb|a écrit|escribió|dice)\b.{0,20})?:?")
_WHEN = re.compile(r"\d{1,2}:\d{2}|\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d+ (?:minutes?|hours?|days?|weeks?|months?|years?) ago")

#: Possessive throughout; a quote opens a value only after an equals sign.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)(?P<shut>>|\Z)|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"([A-Za-z_:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")


def _declared(tag: str, rest: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is outside by what it is, and whether its class or id marks it so."""
    if tag in OUTSIDE or (tag == "header" and not inside):
        return True, False
    marked = False
    if not rest or tag in ("html", "body", "article", "main"):
        return False, False
    for m in _ATTR.finditer(rest):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for own in value.split():
                parts = re.split(r"[^a-z0-9]+", own)
                marked = marked or (parts[0] not in MODIFIERS and not MARKED.isdisjoint(parts))
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True, False
    return False, marked


class Block(NamedTuple):
    text: str
    outside: bool
    linked: int
    article: int
    mark: int
    tag: str = ""
    box: int = 0  # the element it stands in (of a paragraph or heading, the one around that) and the one around it; 0 is the page
    outer: int = 0


class _Blocks:
    """The blocks of one page; marks are numbered from 1, 0 is none; an element's mark is its innermost one."""

    def __init__(self) -> None:
        self.found: list[Block] = []
        self.open: list[tuple[str, bool, int, int, int]] = []  # tag, outside, article, mark, number
        self.tags = [""]  # of every element
        self.ends: dict[int, int] = {}  # the number of blocks when an element ended
        self.count: Counter[str] = Counter()
        self.around = [0]  # the mark around each mark
        self.wrapper: set[int] = set()  # marks that an article or main element lies in
        self.parts: list[str] = []
        self.linked = 0
        self.in_link = 0
        self.articles = 0

    def state(self) -> tuple[bool, int, int]:
        return self.open[-1][1:4] if self.open else (False, 0, 0)

    def end_block(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split()) if self.parts else ""
        if text:
            outside, article, mark = self.state()
            tag = self.open[-1][0] if self.open else ""
            at = [0, 0, *(x[4] for x in self.open[-3:])]
            box, outer = (at[-2], at[-3]) if tag == "p" or tag in HEADINGS or tag == "h1" else (at[-1], at[-2])
            self.found.append(Block(text, outside, self.linked, article, mark, tag, box, outer))
        self.parts, self.linked = [], 0

    def close_to(self, depth: int) -> None:
        for x in self.open[depth:]:
            self.count[x[0]] -= 1
            self.ends[x[4]] = len(self.found)
        del self.open[depth:]

    def start(self, tag: str, rest: str) -> None:
        if tag == "a":
            self.in_link = 1
        if tag == "br":
            self.parts.append(" ")
        outside, article, mark = self.state()
        apart, marked = _declared(tag, rest, article > 0)
        if tag not in BLOCKS and not apart and not marked:
            return
        self.end_block()
        self.in_link = 0
        if tag == "body" or self.open and self.open[-1][0] in ("p", "dt", "dd", "li", "option", "td", "th", "tr") and tag in BLOCKS:
            self.imply(tag)
            outside, article, mark = self.state()
        if tag in ("article", "main") and not article:
            self.articles += 1
            article, at = self.articles, mark
            while at and at not in self.wrapper:
                self.wrapper.add(at)
                at = self.around[at]
        if tag not in VOID and not rest.endswith("/"):
            if marked:
                self.around.append(mark)
                mark = len(self.around) - 1
            self.open.append((tag, outside or apart, article, mark, len(self.tags)))
            self.tags.append(tag)
            self.count[tag] += 1

    def imply(self, tag: str) -> None:
        """Close what the new element closes without an end tag."""
        shut = {"body": ("head",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p")}.get(tag, ("p",))
        depth = len(self.open)
        while depth and self.open[depth - 1][0] in shut:
            depth -= 1
        self.close_to(depth)
        if tag == "body" and self.count["head"]:
            self.close_to([x[0] for x in self.open].index("head"))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = 0
        if self.count[tag]:
            self.end_block()
            depth = len(self.open) - 1
            while self.open[depth][0] != tag:
                depth -= 1
            self.close_to(depth)
        elif tag in BLOCKS:
            self.end_block()


def parse(page: str) -> _Blocks:
    """Blocks and marks of a page; a cut-off tag ends it."""
    out, at = _Blocks(), 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        if m["text"] is not None:
            out.parts.append(m["text"])
            if out.in_link:
                out.linked += len(m["text"].strip())
        elif m["tag"] and m["shut"]:
            tag = m["tag"].lower()
            if m["close"]:
                out.end(tag)
            elif tag in RAW:
                shut = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = shut.end() if shut else len(page)
            else:
                out.start(tag, m["rest"])
    out.end_block()
    return out


def first_pass(block: Block) -> bool | None:
    """The label of a block by its own text, marks aside; None is undecided."""
    text, outside, linked, article = block[:4]
    words = _WORD.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if outside or linked > LINKS_HIGH * len(text):
        return False
    if len(text) < LENGTH_LOW:
        return False if linked and not article else None
    if stops >= STOP_HIGH or article and stops >= STOP_LOW or stops >= STOP_LOW and len(text) > LENGTH_HIGH:
        return True
    return None if article or stops >= STOP_LOW else False


def held_marks(page: _Blocks, label: list[bool | None]) -> list[bool]:
    """Per block, whether a mark leaves it out.

    Marks hold if an unmarked article has text that isn't rejected. Otherwise the one
    that holds most text of articles doesn't, if that is more than all unmarked text;
    and if there is no unmarked text at all, the one with most text doesn't.
    """
    size: Counter[int] = Counter()
    inner: Counter[int] = Counter()
    for b, good in zip(page.found, label):
        if b.article and not b.mark and good is not False:
            return [b.mark > 0 for b in page.found]
        if good:
            size[b.mark] += len(b.text)
            inner[b.mark] += len(b.text) if b.article and b.mark in page.wrapper else 0
    most = max(inner, key=lambda k: (inner[k], -k), default=0)
    if inner[most] <= size[0]:
        most = 0 if size[0] else max(size, key=lambda k: (size[k], -k), default=0)
    dropped: set[int] = set()
    while most:
        dropped.add(most)
        most = page.around[most]
    return [b.mark > 0 and b.mark not in dropped for b in page.found]


def comments(page: _Blocks, label: list[bool | None]) -> list[bool]:
    """Which blocks are reader comments by a heading, by their likeness or by their place; ``label`` is of the first pass."""
    found, out = page.found, [False] * len(page.found)
    good = [x is True for x in label]
    begun = good.index(True) if any(good) else len(found)
    until, rank = 0, ""
    for i, b in enumerate(found):
        if i < until and not (b.tag in HEADINGS and b.tag <= rank):
            out[i] = True
            continue
        until = 0
        if i > begun and b.tag in HEADINGS and len(b.text) < LENGTH_LOW and _COMMENTS.fullmatch(b.text):
            out[i], until, rank = True, page.ends.get(b.box, len(found)), b.tag
    # Posts: runs of neighbouring elements of one parent, to its end.
    runs: dict[int, list[list[int]]] = {}
    for i, b in enumerate(found):
        if b.box and page.tags[b.box] in ("div", "li", "section", "dd", "blockquote"):
            boxes = runs.setdefault(b.outer, [])
            if not boxes or found[boxes[-1][0]].box != b.box:
                boxes.append([])
            boxes[-1].append(i)
    for outer, boxes in runs.items():
        posts = []
        for box in reversed(boxes):
            name = found[box[0]]
            spoken = any(label[i] is not False and len(found[i].text) > len(name.text) for i in box[1:])
            told = len(name.text) <= 60 and name.tag not in HEADINGS and (_NAMED.fullmatch(name.text) or _WHEN.search(name.text))
            if not (len(box) > 1 and told and spoken and page.tags[name.box] == page.tags[found[boxes[-1][0]].box]):
                break
            posts.append(box)
        if len(posts) > 1 and posts[0][-1] + 1 == page.ends.get(outer, len(found)) and posts[-1][0] > begun:
            for i in range(posts[-1][0], posts[0][-1] + 1):
                out[i] = True
    inside = [i for i, b in enumerate(found) if b.article and good[i] and not out[i]]
    if page.articles == 1 and inside:
        last = max(i for i, b in enumerate(found) if b.article)
        behind = [i for i in range(last + 1, len(found)) if good[i]]
        size = lambda at: sum(len(found[i].text) for i in at)
        if size(inside) >= LENGTH_HIGH and 4 * size(inside) >= size(behind):
            out[last + 1 :] = [True] * (len(found) - last - 1)
    return out


def classify(page: _Blocks) -> list[bool]:
    """Which blocks are main text: the two passes."""
    found = page.found
    label = [first_pass(b) for b in found]
    marked = [a or b for a, b in zip(held_marks(page, label), comments(page, label))]
    label = [False if m else x for m, x in zip(marked, label)]
    # For each block its nearest decided neighbours on either side, as (distance, label).
    before: list[tuple[int, bool] | None] = [None] * len(found)
    after: list[tuple[int, bool] | None] = [None] * len(found)
    for near, order in ((before, range(len(found))), (after, range(len(found) - 1, -1, -1))):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            article = found[i].article
            if label[i] is None:
                if article in last:
                    near[i] = (abs(i - last[article][0]), last[article][1])
            elif not (article and (found[i].outside or marked[i])):  # what an article marks as no part of it says nothing of the rest
                last[article] = (i, bool(label[i]))
    out = []
    for i, x in enumerate(label):
        if x is None:
            sides = [s for s in (before[i], after[i]) if s]
            if found[i].article:
                x = not sides or any(s[1] for s in sides)
            else:  # of two as near the one before counts
                x = bool(sides) and min(sides, key=lambda s: s[0])[1]
        out.append(x)
    return out


def main_text(page: str | None) -> str:
    parsed = parse(page or "")
    return " ".join(b.text for b, keep in zip(parsed.found, classify(parsed)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null or empty html, and pages without main text, give an empty text. Broken
    markup is read as far as it goes: missing end tags are implied, a cut-off tag
    ends the page. Bytes that aren't UTF-8 are read as U+FFFD, in the url too. Other
    columns are ignored; equal rows give equal rows.
    """

    def rows(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.make_valid_utf8("url").alias("url"), F.make_valid_utf8("html").alias("html")).mapInArrow(rows, "page_id long, url string, text string, n_chars long")
