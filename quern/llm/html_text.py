"""Main-text extraction from HTML by two-pass block rules.

A page is cut into blocks at block-level tags. First pass: a block is decided
*bad* in boilerplate (menus, footers, hidden parts, text outside the article
where the page has one) or when most of it is link text; *good* when it is long
enough and has a running text's share of stop words; otherwise it stays open.
Second pass: an open block takes the label of its nearest decided neighbours on
its side of the article's border; where they differ it is good inside an
article and bad elsewhere, and where none is decided it is good.

Class, id and role are hints only. A name that wholly means boilerplate
("sidebar", "site-footer") condemns its element unless that holds the main
article; a name that does in part ("related-work"), and a form, need a second
witness: the element holds neither an article nor a main heading nor most of
the page's text (a form: nearly all of it); a name inside an article also needs
short text or many links. html,
body, main and article are never judged by names, but for articles of reader
comments beside or inside another one.

Pages are independent: one map over the table, no shuffle.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do does for from had has have he her him his how
    i if in into is it its just more most my no not of on one only or other our out over she so some such than that the their them
    then there these they this to up us was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais même ne nous on ou où par pas
    plus pour qu que qui sa sans se ses si son sont sur te tu un une vous
    aber als am an auch auf aus bei bin bis da das dass dem den der des die doch durch ein eine einem einen einer er es für hat hatte
    ich ihr im in ist ja kann man mit nach nicht noch nur oder sehr sich sie sind so über um und uns unter vom von vor war was wenn
    wie wird wir zu zum zur
    al como con cuando de del desde donde el ella ellos en entre era es esta este está fue ha hasta la las le lo los más me mi muy no
    nos o para pero por porque que quien se sin sobre son su sus también te tiene un una y ya yo
    """.split()
)
# Elements whose content is never text of the page.
RAW = "script|style|noscript|template|iframe|object|svg|math|textarea|select|title|canvas|audio|video"
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
LEAVES = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 pre figcaption legend summary".split())
VOID = frozenset("br hr".split())
BOILERPLATE = frozenset("nav footer aside menu head dialog".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
# Words in class and id that name boilerplate; the second line only outside an article.
BAD_NAMES = frozenset("ad ads adv advert advertisement adverts adsense adsbygoogle banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
BAD_OUTSIDE = frozenset("alert copyright disclaimer header legal masthead topbar".split())
# Words beside them that change nothing, words that turn them round, names of paid or hidden inline parts, and of reader comments.
NEUTRAL = frozenset("area article articles author bar block blog body bottom box button buttons container entry form global group inner item items left link links list main material meta mobile new page panel post posts primary right row secondary section site small sticky text thread top user wrap wrapper".split())
NEGATIONS = frozenset("no not has have with without non".split())
INLINE_NAMES = frozenset("ad ads adv advert advertisement adsense adsbygoogle sponsored hidden sr visuallyhidden".split())
COMMENT_NAMES = frozenset("comment comments reply".split())
NEVER_NAMED = frozenset("html body main article".split())
CONTROLS = frozenset("button label".split())

TOKEN = re.compile(
    r"""<(?:svg|math)\b(?:[^>"']|"[^"]*"|'[^']*')*+>(?<=/>)|"""
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
WORD = re.compile(r"\w+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Elements whose id names a place in an article, such as a heading's slug; elements that boilerplate and whole pages come in; elements without an end.
NAMED_PLACES = frozenset("h1 h2 h3 h4 h5 h6 section p a span dt li figure".split())
FORMS = frozenset("form fieldset".split())
EMPTY = frozenset("img input wbr link meta base col embed source track area param".split())
GOOD, BAD, OPEN = 1, 0, None


class Hints(NamedTuple):
    hidden: bool = False
    whole: bool = False  # a name that wholly means boilerplate
    partly: bool = False  # a name that does in part
    paid: bool = False  # by whole names of INLINE_NAMES
    comment: bool = False  # by whole names of COMMENT_NAMES
    main: bool = False


def hints_of(attrs: str, name: str, in_article: bool) -> Hints:
    """What an element's attributes say about it."""
    if not attrs or attrs.isspace():
        return Hints()
    bad_names = BAD_NAMES if in_article else BAD_NAMES | BAD_OUTSIDE
    out = Hints()
    for key, value in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), html_lib.unescape(value.strip("\"'"))
        if key == "class" or key == "id" and not (in_article and name in NAMED_PLACES):
            for token in value.split():
                parts = [x.lower() for x in NAME_PART.findall(token)]
                bad = [x for x in parts if x in bad_names]
                if not bad or NEGATIONS & set(parts):
                    out = out._replace(paid=out.paid or parts[:1] == ["hidden"] or token.lower() in ("sr-only", "visuallyhidden"))
                    continue
                whole = all(x in bad_names or x in NEUTRAL or x.isdigit() for x in parts)
                out = out._replace(whole=out.whole or whole, partly=out.partly or not whole)
                out = out._replace(paid=out.paid or whole and bool(INLINE_NAMES & set(bad)), comment=out.comment or whole and bool(COMMENT_NAMES & set(bad)))
        elif key == "role":
            out = out._replace(whole=out.whole or value.lower() in BAD_ROLES, main=out.main or value.lower() in ("main", "article"))
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDING.search(value):
            out = out._replace(hidden=True)
    return out


class Element(NamedTuple):
    """An open element: bad in itself or by an ancestor, how many articles it is in, and the hinted elements it is in."""

    name: str
    bad: bool = False
    inside: int = 0
    hinted: tuple[int, ...] = ()


class Hinted:
    """An element that hints speak against, and what it turns out to hold."""

    def __init__(self, whole: bool, inside: int, comment: bool, form: bool):
        self.whole, self.inside, self.comment, self.form = whole, inside, comment, form
        self.chars = self.link_chars = 0
        self.main = self.heading = False

    def stands(self, chars: int) -> bool:
        """Whether the hint holds, in a page with so much text that is not bad in itself."""
        if self.comment:
            return 2 * self.chars <= chars
        if self.whole:
            return not self.main
        if self.main or self.heading:
            return False
        if self.form:  # one may wrap a whole page
            return 10 * self.chars <= 9 * chars
        if 2 * self.chars > chars:
            return False
        return not self.inside or self.chars <= 200 or self.link_chars > 0.3 * self.chars


class Block(NamedTuple):
    text: str
    link_chars: int
    bad: bool  # in boilerplate
    inside: bool  # in an article
    element: str
    hinted: tuple[int, ...] = ()
    nested: bool = False  # in an article inside another one


class _Cutter:
    """Cuts one page into blocks."""

    def __init__(self):
        self.found: list[Block] = []
        self.hinted: list[Hinted] = []
        self.stack: list[Element] = []
        self.parts: list[str] = []
        self.link_chars = self.links = self.articles = 0
        #: An inline element whose text is left out: name, depth of equal names, open blocks around it.
        self.muted: list | None = None

    @property
    def top(self) -> Element:
        return self.stack[-1] if self.stack else Element("")

    def flush(self) -> None:
        text = " ".join(html_lib.unescape("".join(self.parts)).split())
        if text:
            top, link_chars = self.top, min(self.link_chars, len(text))
            self.found.append(Block(text, link_chars, top.bad, top.inside > 0, top.name, top.hinted, sum(x.name == "article" for x in self.stack) > 1))
            for k in () if top.bad else top.hinted:
                self.hinted[k].chars += len(text)
                self.hinted[k].link_chars += link_chars
        self.parts.clear()
        self.link_chars = 0

    def add(self, text: str) -> None:
        if text and not self.muted:
            self.parts.append(text)
            if self.links:
                self.link_chars += len(html_lib.unescape(text).strip())

    def inline(self, name: str, close: bool, attrs: str) -> None:
        if name == "a":
            self.links = max(0, self.links - 1) if close else self.links + 1
        if self.muted:
            if name == self.muted[0]:
                self.muted[1] += -1 if close else 1
                if not self.muted[1]:
                    self.muted = None
        elif not close and name not in EMPTY and not attrs.rstrip().endswith("/"):
            hints = hints_of(attrs, name, self.top.inside > 0)
            if name in CONTROLS or hints.hidden or hints.paid:
                self.muted = [name, 1, len(self.stack)]

    def close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name == name:
                del self.stack[i:]
                break
        if self.muted and len(self.stack) < self.muted[2]:
            self.muted = None

    def open(self, name: str, attrs: str) -> None:
        while self.stack and self.stack[-1].name in LEAVES and (name not in ("ul", "ol", "dl", "table") or self.stack[-1].name == "p"):
            self.stack.pop()
        if self.muted and len(self.stack) < self.muted[2]:
            self.muted = None
        _, bad, inside, within = self.top
        self.links = 0
        hints = hints_of(attrs, name, inside > 0)
        article = name in ("main", "article") or hints.main
        if name == "article":
            self.articles += 1
        for k in within:
            # the first article of a page is its main one, unless it is a comment
            self.hinted[k].main |= article and (name != "article" or self.articles == 1) and not hints.comment
            self.hinted[k].heading |= article or name == "h1"
        bad = bad or hints.hidden or name in BOILERPLATE or (name == "header" and not inside)
        if name == "article" and hints.comment or name not in NEVER_NAMED and not hints.main and (hints.whole or hints.partly or name in FORMS):
            within = (*within, len(self.hinted))
            self.hinted.append(Hinted(hints.whole, inside, name == "article", name in FORMS))
        self.stack.append(Element(name, bad, inside + article, within))


def blocks(page: str) -> list[Block]:
    """Every block that has text, in page order; those under a hint that stands are bad."""
    cutter, at = _Cutter(), 0
    for m in TOKEN.finditer(page):
        cutter.add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name not in BLOCKS:
            cutter.inline(name, bool(m["close"]), m["attrs"])
            continue
        cutter.flush()
        if m["close"]:
            cutter.close(name)
        elif name not in VOID:
            cutter.open(name, m["attrs"])
    cutter.add(page[at:])
    cutter.flush()
    found = cutter.found
    chars = sum(len(x.text) for x in found if not x.bad)
    against = [k for k, x in enumerate(cutter.hinted) if x.stands(chars)]
    if against:
        found = [x._replace(bad=True) if set(x.hinted) & set(against) else x for x in found]
    # articles inside an article are comments on it, unless the outer one only wraps them
    own = sum(len(x.text) for x in found if x.inside and not x.bad and not x.nested and x.element != "h1")
    if own >= sum(len(x.text) for x in found if x.nested and not x.bad):
        found = [x._replace(bad=True) if x.nested else x for x in found]
    return found


def _nearest(labels: list[int | None], found: list[Block], step: int) -> list[int | None]:
    """For each block the last decided label before it in this direction, on its side of the article's border.

    Blocks in boilerplate say nothing about their neighbours.
    """
    out: list[int | None] = []
    last: dict[bool, int | None] = {}
    for label, block in zip(labels[::step], found[::step], strict=True):
        if label is not OPEN and not block.bad:
            last[block.inside] = label
        out.append(last.get(block.inside))
    return out[::step]


def main_text(page: str, *, least_chars: int = 70, stop_density: float = 0.2, link_density: float = 0.5) -> str:
    """Main text of one page; good blocks in page order, joined by one space."""
    found = blocks(page)
    has_article = any(x.inside and not x.bad for x in found)
    labels: list[int | None] = []
    for x in found:
        linked = x.link_chars > link_density * len(x.text)
        if x.bad or (has_article and not x.inside) or (linked and not (x.inside and x.element == "p")):
            labels.append(BAD)
            continue
        words = WORD.findall(x.text.lower()) if len(x.text) >= least_chars and not linked else []
        labels.append(GOOD if words and sum(w in STOP_WORDS for w in words) >= stop_density * len(words) else OPEN)
    before, after = (_nearest(labels, found, step) for step in (1, -1))
    kept = []
    for x, label, left, right in zip(found, labels, before, after, strict=True):
        if label is OPEN:
            near = {left, right} - {None}
            label = near.pop() if len(near) == 1 else GOOD if x.inside or not near else BAD
        if label == GOOD:
            kept.append(x.text)
    return " ".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null and empty html give the empty text, 0 characters. Markup that never
    closes runs to the page's end. Null ids and urls stay null, repeated rows
    give a row each, other columns are ignored.
    """
    prepare(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    out = base.mapInArrow(_extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
