"""Main text of web pages by block rules in two passes.

A page is cut into blocks of text.  The first pass decides what it can: by the elements and
names a block stands in, by the density of links, by length and the density of stop words;
by length and links alone where the words are those of another language.  In the second, undecided blocks take the label of the nearest decided ones around them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecourt.llm.text import slices

#: Very frequent words of the languages that pages are in.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be been but by can could do for from had has have he her his how i if
    in into is it its more no not of on one or other our out over she so some such than that the their them then there
    these they this to up was we were what when which who will with would you your
    à au aussi aux avec ce ces cette comme dans de des du elle elles en est et être eu il ils je la le les leur lui mais
    me même mes moi mon ne nos notre nous on ou où par pas plus pour qu que qui sa se ses si son sont sur ta te tu un une
    vous y
    al como con del desde donde dos el ella ellos era es esa ese eso esta este esto fue ha han hasta hay la las lo los
    más muy ni o para pero por porque que se sin sobre son su sus también tiene todo uno unos ya
    aber als am auch auf aus bei bin bis das dass dem den der des die dies doch durch ein eine einem einen einer er es für
    hat hatte ich ihr im ist kann keine mit nach nicht noch nur oder sich sie sind so über um und unter vom von vor war
    was wenn werden wie wird wir zu zum zur
    """.split()
)

#: Elements whose text is never shown, or is a control's.
RAW = frozenset("script style noscript template iframe object svg math textarea select title head audio video canvas".split())
#: Elements that hold what surrounds an article.
AROUND = frozenset("nav header footer aside form menu dialog button fieldset".split())
ARTICLE = frozenset(["article", "main"])
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot
    th thead tr ul
    """.split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of their kind in the same list, table or text.
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table article main section div body nav aside header footer form blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class names and ids that mark what surrounds an article.
MARK_WORDS = frozenset(
    """
    ad adbox ads adsbygoogle adsense adslot banner banners breadcrumb breadcrumbs consent cookie cookies copyright dfp
    footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice outbrain overlay pager
    pagination popup promo promos promotion rail recommended related repl respond share sharing sidebar signup social
    subscribe subscription taboola toolbar topbar trending widget widgets
    """.split()
)
#: Words that mark it however much text stands there.
STRICT_WORDS = frozenset("advert advertisement adverts comment comments disqus replies sponsor sponsored".split())
#: Words that say a name is about how a page is laid out, not about what the element holds.
LAYOUT_WORDS = frozenset("has is no not off on with without".split())
#: Parts of names that mark an article's own elements, whatever else they say.
OWN_WORDS = frozenset("article entry post story content main".split())

LONG, SHORT = 200, 70
MAX_LINK_DENSITY = 0.4
STOP_LOW, STOP_HIGH = 0.15, 0.3
#: Stop words of all words, below which a page is in a language that has none here.
STOP_KNOWN = 0.25
#: Letters without spaces between words say about three times as much.
WIDE = 3
#: So many linked blocks in a row are a list of links.
LINK_LIST = 3
#: The share of the good text that articles must hold for what stands outside to be bad.
MOST = 2 / 3

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff]")
_BEYOND_LATIN = re.compile(r"[^\W\d_\u0000-\u024f\u1e00-\u1eff]")


_TAG_START = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z]|/[^a-zA-Z])")
#: The same where quotes no longer count.
_LENIENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_DECLARATION = re.compile(r"<[!?]")
#: Marked elements inside one another that are told apart.
DEEPEST = 16


@dataclass
class Block:
    """Text between two block elements, and where it stands."""

    text: str
    link_chars: int
    excluded: bool
    heading: bool
    article: int  # number of the article that holds it, 0 for none
    marks: tuple[int, ...] = ()  # numbers of the elements around it whose names mark a margin


@dataclass
class _Open:
    name: str
    excluded: bool = False
    article: int = 0
    heading: bool = False
    firm: bool = False  # excluded by more than a form or an unclosed menu
    marks: tuple[int, ...] = ()


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    link_chars: int = 0
    articles: int = 0
    marks: int = 0


#: What an element says of itself: nothing, that its name marks a margin, that it is none of the article.
PLAIN, MARKED, AWAY = 0, 1, 2


def _marked(attributes: str) -> int:
    """What names, role or style of an element say: ``PLAIN``, ``MARKED`` or ``AWAY``.

    Names count by whole words.  One that speaks of layout (``no-sidebar``, ``has-menu``) says
    nothing, and words of an article's own elements outweigh those of margins.
    """
    if not attributes:
        return PLAIN
    found = PLAIN
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            parts: set[str] = set()
            for one in html.unescape(value).split():
                words = {w.lower() for w in _NAME_PARTS.findall(one)}
                if not words & LAYOUT_WORDS:
                    parts |= words
            if parts & STRICT_WORDS:
                return AWAY
            if parts & MARK_WORDS and not parts & OWN_WORDS:
                found = MARKED
        elif name == "role" and value.lower() in ROLES:
            return AWAY
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return AWAY
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return AWAY
    return found


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, white space inside made one space, empty ones left out.

    Time is in proportion to the page, however broken: no tag is looked for behind the last
    ``>``, quotes count no more once one has been found open, and the elements that are open
    are counted by name.
    """
    found, stack, links, at = _Page(), [_Open("")], 0, 0
    stop, last = len(page), page.rfind(">") + 1
    strict, endless, opened_names = True, set(), Counter()

    def flush() -> None:
        text = " ".join(html.unescape("".join(found.pieces)).split())
        if text:
            top = stack[-1]
            found.blocks.append(Block(text, min(found.link_chars, len(text)), top.excluded, top.heading, top.article, top.marks))
        found.pieces, found.link_chars = [], 0

    def add(text: str) -> None:
        found.pieces.append(text)
        if links and text:
            found.link_chars += len(" ".join(html.unescape(text).split()))

    def close(depth: int) -> None:
        for gone in stack[depth:]:
            opened_names[gone.name] -= 1
        del stack[depth:]

    while at < stop:
        token = None
        if at < last:
            begin = _TAG_START.search(page, at, last)
            if begin is not None:
                token = (_TOKEN if strict else _LENIENT).match(page, begin.start(), last)
                if token is None and strict:
                    strict = False  # a quote stays open: from here on tags end at the next >
                    token = _LENIENT.match(page, begin.start(), last)
        if token is None:
            tail = page[at:]
            open_end = _DECLARATION.search(tail)
            add(tail[: open_end.start()] if open_end else tail)
            break
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        if token[2] is None:
            if token[0].startswith("<!--") and not token[0].endswith((">",)):
                break  # a comment that is never closed hides the rest
            continue
        name, closing = token[2].lower(), bool(token[1])
        if name in RAW and not closing:
            if not token[3].rstrip().endswith("/"):
                end = None if name in endless else _raw_end(name).search(page, at)
                if end is None:
                    endless.add(name)
                # The head may lack its end; it ends where the body begins.
                if end is None and name == "head":
                    continue
                at = end.end() if end else stop
            continue
        if name == "a":
            links = max(0, links - 1) if closing else 1
            continue
        if name == "br":
            add(" ")
            continue
        is_block = name in BLOCKS
        if is_block:
            flush()
            links = 0 if name not in ("td", "li", "p", "div") or closing else links
        if closing:
            if is_block and opened_names[name]:
                close(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth].name == name))
            elif stack[-1].name == name and len(stack) > 1:
                close(len(stack) - 1)
            continue
        if name in VOID:
            continue
        top = stack[-1]
        if is_block and top.name == "p":
            close(len(stack) - 1)
        elif name in CLOSED_BY and any(opened_names[n] for n in CLOSED_BY[name]):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in CLOSED_BY[name]:
                    close(depth)
                    break
                if stack[depth].name in SCOPES:
                    break
        if not is_block and name not in AROUND and not token[3]:
            continue  # plain inline markup changes nothing for its text
        top = stack[-1]
        opened = _Open(name, top.excluded, top.article, top.heading or name in HEADINGS, top.firm, top.marks)
        if name in ARTICLE:
            # A form or an unclosed menu around a whole article is no reason to lose it.
            if opened.excluded and not opened.firm:
                opened.excluded = False
            if not opened.article and not opened.excluded:
                found.articles += 1
                opened.article = found.articles
        says = PLAIN if name in ("body", "html") else _marked(token[3])
        if name in AROUND and not (name == "header" and top.article):
            opened.excluded = True
            opened.firm = top.firm or name not in ("form", "nav", "fieldset")
        elif says == AWAY:
            opened.excluded = opened.firm = True
        elif says == MARKED:
            found.marks += 1
            opened.marks = (*top.marks, found.marks) if len(top.marks) < DEEPEST else top.marks
        if not token[3].rstrip().endswith("/") or is_block:
            stack.append(opened)
            opened_names[name] += 1
    flush()
    return found.blocks


_RAW_ENDS: dict[str, re.Pattern] = {}


def _raw_end(name: str) -> re.Pattern:
    if name not in _RAW_ENDS:
        _RAW_ENDS[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)
    return _RAW_ENDS[name]


def _width(text: str) -> int:
    return len(text) if text.isascii() else len(text) + (WIDE - 1) * len(_WIDE.findall(text))


def _linked(block: Block) -> bool:
    return block.link_chars > MAX_LINK_DENSITY * len(block.text)


def _words(block: Block) -> tuple[int, int]:
    """Stop words and words of a block; no words where most letters are beyond Latin script."""
    text = block.text.lower()
    if not text.isascii() and 2 * len(_BEYOND_LATIN.findall(text)) > sum(map(str.isalpha, text)):
        return 0, 0
    words = _WORD.findall(text)
    return sum(w in STOP_WORDS for w in words), len(words)


def _dealt(found: list[Block]) -> dict[int, bool | None]:
    """Long blocks without many links: good, bad, or None, wherever they stand.

    Where a page or a block is in a language without stop words here, length decides; if no
    block is long enough for that, those that are not short are good.
    """
    counted = {
        i: (*_words(b), _width(b.text))
        for i, b in enumerate(found)
        if not b.excluded and not b.heading and not _linked(b) and (len(b.text) >= SHORT or _width(b.text) >= SHORT)
    }
    known = sum(c[0] for c in counted.values()) >= STOP_KNOWN * sum(c[1] for c in counted.values())
    dealt: dict[int, bool | None] = {}
    for i, (stops, words, width) in counted.items():
        density = stops / words if words else 0.0
        if density >= STOP_HIGH or (density >= STOP_LOW and width >= LONG):
            dealt[i] = True
        elif density >= STOP_LOW:
            dealt[i] = None
        elif known and words:
            dealt[i] = False
        else:
            dealt[i] = True if width >= LONG else None
    if True not in dealt.values():
        for i, (stops, words, _) in counted.items():
            if dealt[i] is None and not (known and words):
                dealt[i] = True
    return dealt


def _settle_articles(found: list[Block], dealt: dict[int, bool | None]) -> bool:
    """True if articles hold ``MOST`` of the good text, so what stands outside is bad.

    Articles without good text lose their number where others, or what stands outside, have
    any: they are teasers, and their blocks are judged as all others are.
    """
    good: dict[int, int] = {}
    for i, label in dealt.items():
        if label:
            good[found[i].article] = good.get(found[i].article, 0) + len(found[i].text)
    if good:
        for b in found:
            if b.article not in good:
                b.article = 0
    inside = sum(n for article, n in good.items() if article)
    return any(b.article and not b.excluded for b in found) and inside >= MOST * sum(good.values())


def _link_lists(found: list[Block]) -> set[int]:
    """Linked blocks of one kind that stand ``LINK_LIST`` or more in a row."""
    lists: set[int] = set()
    run: list[int] = []
    for i, b in enumerate(found):
        if run and (b.heading, b.article) != (found[run[-1]].heading, found[run[-1]].article) or not _linked(b):
            run = []
        if _linked(b):
            run.append(i)
            if len(run) >= LINK_LIST:
                lists.update(run)
    return lists


def first_pass(found: list[Block]) -> list[bool | None]:
    """Good, bad, or None where length and words decide nothing.

    An article is evidence: it leaves undecided what would be bad, but for lists of links,
    and where articles hold most of the good text, what stands outside is bad.  Elsewhere a
    linked heading stays undecided only right before good text.  The number of an article that
    turns out to hold teasers is taken from its blocks.
    """
    dealt = _dealt(found)
    named = _settle_articles(found, dealt)
    lists = _link_lists(found)
    labels: list[bool | None] = [None] * len(found)
    for i in range(len(found) - 1, -1, -1):
        b = found[i]
        if b.excluded or (named and not b.article) or i in lists:
            label = False
        elif _linked(b):
            label = None if b.article or (b.heading and i + 1 < len(found) and labels[i + 1]) else False
        else:
            label = dealt.get(i)
            if label is False and b.article:
                label = None
        labels[i] = label
    return labels


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided block before or behind them.

    Between a good and a bad one the nearer counts, and the good one if both are as near.
    Within a named article only its own blocks count, and what surrounds it or stands in it
    as a link list does not: if nothing in it is good, its undecided blocks are.
    """
    total = len(found)
    before: list[tuple[int, bool] | None] = [None] * total
    behind: list[tuple[int, bool] | None] = [None] * total
    for order, nearest in ((range(total), before), (range(total - 1, -1, -1), behind)):
        last, scope = None, None
        for i in order:
            if found[i].article and found[i].excluded:
                continue
            if found[i].article != scope:
                last, scope = None, found[i].article
            if labels[i] is not None and (labels[i] or not scope):
                last = (i, labels[i])
            nearest[i] = last
    out = []
    for i, label in enumerate(labels):
        if label is None:
            sides = [s for s in (before[i], behind[i]) if s]
            if not sides:
                label = bool(found[i].article)
            else:
                distance = lambda s: (abs(s[0] - i), not s[1])  # noqa: E731, B023
                label = min(sides, key=distance)[1]
        out.append(bool(label))
    return out


def settle_marks(found: list[Block]) -> None:
    """Exclude blocks in elements whose names mark a margin, but for those that hold the page's text.

    An element with ``MOST`` of the good text is no margin whatever it is called, unless an
    article outside of it has good text.
    """
    if not any(b.marks for b in found):
        return
    good = [found[i] for i, label in _dealt(found).items() if label]
    inside: Counter[int] = Counter()
    for b in good:
        for mark in b.marks:
            inside[mark] += len(b.text)
    total = sum(len(b.text) for b in good)
    text = {m for m, n in inside.items() if n >= MOST * total and all(m in b.marks or not b.article for b in good)}
    for b in found:
        b.excluded = b.excluded or not text.issuperset(b.marks)


def main_text(page: str) -> str:
    """The text of the good blocks in page order, one per line; empty if there is none."""
    found = blocks(page)
    settle_marks(found)
    good = second_pass(found, first_pass(found))
    return "\n".join(b.text for b, g in zip(found, good) if g)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of ``pages``.

    Pages are read whole, a few at a time, and need no shuffle.  NULL html is empty and gives
    an empty text; repeated rows each get a row; other columns are not read.
    """
    read = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(body).alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts = [main_text(p or "") for p in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return read.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
