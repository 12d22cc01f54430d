"""Main text of web pages by two passes of block rules.

A page is cut at block tags; controls and pictures inside a sentence are left out
of it without cutting it. Pass one decides each block from the container it stands
in, its link density, its length and the density of stop words: blocks in menus,
adverts, forms and the like and blocks of links are left out, long blocks and blocks
with enough stop words are kept, short ones stay open. Where a page marks its
article, only the article can hold main text. Where it does not, long blocks without
enough stop words stay open too, and are kept if most words of the page's long
blocks stand in such blocks: the stop words are English, German, French and Spanish,
so the page is in another language, or a table or code. Pass two gives open blocks
the label of the nearest decided neighbour, inside the article first. In scripts
written without blanks two characters count as a word.

Class and id name an unwanted container if a name is an unwanted word, or is put
together of unwanted words and words for parts of a page (`site-footer`, but not
`has-sidebar`). Such a container, or a form, does not count as unwanted if it holds
the article, or if nothing long stands outside and it holds most of the page (not so
comments, adverts, menus and consent). Articles do not mark a page if more long text
stands outside of them; several of them are then cards, and left out.

Null and empty pages give an empty text. Repeated pages stand for themselves.
Unclosed tags end with the block that holds them; a page cut off in a tag or
comment keeps the text before it. Extra columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from panelwise.llm.common import bounded, col, slices, strings

LONG_WORDS = 12
STOP_DENSITY = 0.2
LINK_DENSITY = 0.5

# Elements by what the rules do with them, and words of class names.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav footer aside script style noscript template dialog menu".split())
INLINE_DROPPED = frozenset("svg math button select textarea iframe object canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption noscript template".split()
)
CLOSES_P = BLOCKS - {"option", "noscript", "template", "body", "html", "head"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl div section article main body td th blockquote form nav aside header footer".split())
UNWANTED = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager sidebar sidenav aside rail footer foot header masthead banner "
    "topbar toolbar ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion promoted teaser outbrain taboola "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox subscribe subscription newsletter signup login register "
    "social share sharing sharebar follow related recommended recommendations trending popular comment comments disqus respond responses replies reply "
    "feedback reviews widget widgets copyright legal disclaimer tags tagcloud search searchbox form skip hidden print tooltip".split()
)
COMPANIONS = frozenset(
    "site page main top bottom left right primary secondary global local sticky fixed mobile desktop box bar list item items wrapper wrap container "
    "block inner outer area section panel link links button buttons icon icons row column col module region zone slot title post posts entry article "
    "articles story stories blog user reader news content unit form header footer holder group text message body meta count author thread feed grid card cards tab tabs 1 2 3 4 5".split()
)
NEVER_MAIN = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager ad ads adv advert adverts advertisement advertising adbox adslot "
    "sponsor sponsored outbrain taboola cookie cookies consent gdpr comment comments disqus respond responses replies reply".split()
)
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog status tablist".split())
ARTICLE_WORDS = frozenset("article post-content entry-content article-body articlebody post-body story-body main-content content-body".split())
STOP_WORDS = frozenset(
    "the of and to in a is that for it on with as was by at be this from are or an not have had which but were they their its he she his her you we "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou mais nous vous aux "
    "el los las y en que del se por con una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre".split()
)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_OTHER_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_QUOTE_OR_END = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))")
_QUOTED = re.compile(r"\"[^\"]*+\"|'[^']*+'")
_HIDDEN = re.compile(r"(?:^|\s|\")hidden(?=\s|=|/|$)", re.I)
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]{2}")
_NAME_PARTS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…“”„‘’«»–—"
_LI_SCOPES = {tag: SCOPES - {"td", "th"} if tag == "tr" else SCOPES - {tag} for tag in SAME_CLOSES}


@dataclass
class Block:
    """Text of one block, with what the rules look at."""

    text: str
    words: int
    link_words: int
    unwanted: bool  # in an element that never holds main text
    article: int  # number of the outermost article, or 0
    inside: int = 0  # number of the innermost form or container with an unwanted name, or 0

    @property
    def links(self) -> bool:
        return self.link_words > LINK_DENSITY * self.words

    @property
    def long(self) -> bool:
        return self.words >= LONG_WORDS and not self.links

    def has_stop_words(self, density: float) -> bool:
        return sum(w.strip(_PUNCTUATION) in STOP_WORDS for w in self.text.lower().split(" ")) >= density * self.words


@dataclass
class _Open:
    tag: str
    unwanted: bool
    article: int
    link: bool
    skipped: bool = False
    inside: int = 0


def _word_count(words: list[str]) -> int:
    """Words; of scripts without blanks two characters count as one."""
    return len(words) if all(map(str.isascii, words)) else sum(max(len(_UNSPACED.findall(w)), 1) for w in words)


_ROOT = _Open("", False, 0, False)


_PLAIN: tuple[set, str, bool] = (set(), "", False)


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    state: _Open = field(default_factory=lambda: _ROOT)  # where the block that is being read began
    stack: list[_Open] = field(default_factory=list)
    opened: Counter = field(default_factory=Counter)
    articles: list[int] = field(default_factory=lambda: [0])  # by number: the container that holds it
    # by number: the container around it, and whether it and all around it may turn out to hold the main text
    containers: list[tuple[int, bool]] = field(default_factory=lambda: [(0, True)])

    def top(self) -> _Open:
        return self.stack[-1] if self.stack else _ROOT

    def text(self, raw: str) -> None:
        state = self.top()
        if raw and not state.skipped:
            if not self.parts:
                self.state = state
            self.parts.append(raw)
            if state.link:
                self.linked.append(raw)

    def flush(self) -> None:
        """End the block that is being read."""
        if not self.parts:
            return
        words = unescape("".join(self.parts)).split()
        if words:
            linked = _word_count(unescape(" ".join(self.linked)).split()) if self.linked else 0
            at = self.state
            self.blocks.append(Block(" ".join(words), _word_count(words), linked, at.unwanted, at.article, at.inside))
        self.parts, self.linked = [], []

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS or tag in DROPPED:
            self.flush()
        elif tag == "br":
            self.text(" ")
        if tag in CLOSES_P:
            self.close("p", within=SCOPES)
        if tag in SAME_CLOSES:
            for other in SAME_CLOSES[tag]:
                self.close(other, within=_LI_SCOPES[tag])
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            return
        state = self.top()
        self.opened[tag] += 1
        if tag not in BLOCKS and tag not in DROPPED and tag != "span":
            skipped = state.skipped or tag in INLINE_DROPPED
            self.stack.append(_Open(tag, state.unwanted, state.article, state.link or tag == "a", skipped, state.inside))
            return
        names, role, hidden = _described(attributes) if attributes else _PLAIN
        unwanted = tag in DROPPED or role in UNWANTED_ROLES or hidden or tag == "header" and not state.article
        marks = tag in ("article", "main") or role in ("main", "article") or bool(names & ARTICLE_WORDS)
        inside, words = state.inside, set()
        if tag not in ("main", "body", "html") and not names & ARTICLE_WORDS:
            words = {w for name in names for w in unwanted_words(name)}
        if words or tag == "form":
            self.containers.append((inside, self.containers[inside][1] and not words & NEVER_MAIN))
            inside = len(self.containers) - 1
        article = state.article
        if marks and not article and not words:
            self.articles.append(inside)
            article = len(self.articles) - 1
        if tag == "span" and (unwanted or words):  # inline: left out of its sentence
            self.stack.append(_Open(tag, state.unwanted, state.article, state.link, True, state.inside))
            return
        self.stack.append(_Open(tag, state.unwanted or unwanted, article, state.link or tag == "a", state.skipped, inside))

    def close(self, tag: str, within: frozenset = frozenset()) -> None:
        """Close the innermost element of this name, with all it holds; not beyond the given elements."""
        if not self.opened[tag]:
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].tag == tag:
                if tag in BLOCKS or tag in DROPPED:
                    self.flush()
                self.opened.subtract(o.tag for o in self.stack[depth:])
                del self.stack[depth:]
                return
            if self.stack[depth].tag in within:
                return


def unwanted_words(name: str) -> set[str]:
    """The unwanted words of a class name or id, if it is made of such words and words for parts of a page alone."""
    parts = {p for p in _NAME_PARTS.split(name) if p}
    found = parts & UNWANTED
    return found if found and parts <= UNWANTED | COMPANIONS else set()


def _described(attributes: str) -> tuple[set[str], str, bool]:
    """Names in class and id, the role, and whether the element is hidden."""
    names, role, hidden = set(), "", bool(_HIDDEN.search(_QUOTED.sub('""', attributes)))
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), unescape(next((g for g in m.groups()[1:] if g is not None), ""))
        if name in ("class", "id"):
            names |= {_CAMEL.sub("-", n).lower() for n in value.split()}
        elif name == "role":
            role = value.strip().lower()
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "").lower()
        elif name == "aria-hidden":
            hidden = hidden or value.strip().lower() == "true"
    return names, role, hidden


def _tag_end(html: str, at: int, failed: set[int]) -> int:
    """Place of the > that ends a tag, quoted values of any length skipped; with an open quote, of the first >; or -1.

    `failed` keeps the places outside quotes from which no end was found, so that all searches of a page are linear.
    """
    begin, seen = at, []
    while (m := _QUOTE_OR_END.search(html, at)) and m.start() not in failed:
        if m.group() == ">":
            return m.start()
        seen.append(m.start())
        close = html.find(m.group(), m.end())
        if close < 0:
            break
        at = close + 1
    failed.update(seen)
    return html.find(">", begin)


def read(html: str) -> _Page:
    """A page cut into blocks in order, without scripts, styles, comments and markup."""
    page, at, last = _Page(), 0, html.rfind(">")
    failed: set[int] = set()
    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            page.text(html[at:])
            break
        page.text(html[at:lt])
        mark = _TAG.match(html, lt) if lt <= last else None
        end = _tag_end(html, mark.end(), failed) if mark else -1
        other = _OTHER_MARK.match(html, lt) if end < 0 else None
        if other:
            at = other.end()
            continue
        if end < 0:
            if html[lt + 1 : lt + 2].isalpha() and lt > last:
                break  # cut off in a tag
            page.text("<")
            at = lt + 1
            continue
        at = end + 1
        ends, tag, attributes = mark.group(1), mark.group(2).lower(), html[mark.end() : end]
        if ends:
            if tag == "p" and not page.opened["p"]:
                page.flush()
            page.close(tag)
        elif tag in RAW:  # the text of these ends only with their own end tag
            if tag == "title":
                page.flush()
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
        else:
            page.open(tag, attributes)
    page.flush()
    return page


def settled(page: _Page) -> list[Block]:
    """Blocks with containers and articles judged by what they hold: `unwanted` and `article` as the rules take them.

    Of long texts only, if there are any: the largest article in containers that
    may hold main text frees them if it is at least as large as all that stands
    in none; if nothing does, the container with most text of its own is freed.
    """
    found = [b for b in page.blocks if not b.unwanted]
    weigh = (lambda b: b.words * b.long) if any(b.long for b in found) else (lambda b: b.words * (not b.links))
    own, held = Counter(), Counter()
    for b in found:
        own[b.inside] += weigh(b)
        if page.articles[b.article] == b.inside:
            held[b.article] += weigh(b)
    freed = {0}

    def free(container: int) -> None:
        while container not in freed:
            freed.add(container)
            container = page.containers[container][0]

    best = max((a for a in held if a and page.containers[page.articles[a]][1]), key=lambda a: (held[a], -a), default=0)
    if best and held[best] and held[best] >= own[0]:
        free(page.articles[best])
    if not sum(own[c] for c in freed):
        free(max((c for c in own if page.containers[c][1]), key=lambda c: (own[c], -c), default=0))
    out = [Block(b.text, b.words, b.link_words, b.unwanted or b.inside not in freed, b.article) for b in page.blocks]
    inner, outer = (sum(weigh(b) for b in out if not b.unwanted and bool(b.article) == a) for a in (True, False))
    if outer > inner:
        cards = len({b.article for b in out if b.article and not b.unwanted}) > 1
        out = [Block(b.text, b.words, b.link_words, b.unwanted or cards and b.article > 0, 0) for b in out]
    return out


def labels(found: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    marked = any(b.article and not b.unwanted for b in found)
    decided: list[bool | None] = []
    long = [] if marked else [b for b in found if not b.unwanted and b.long]
    # whether most of the text is in none of the languages of the stop words
    other = sum(b.words if b.has_stop_words(STOP_DENSITY) else -b.words for b in long) < 0
    for b in found:
        if b.unwanted or marked and not b.article:
            decided.append(False)
        elif b.links and not (b.article and b.words - b.link_words >= LONG_WORDS):
            decided.append(False)
        elif b.article and b.words >= LONG_WORDS:
            decided.append(True)
        elif b.has_stop_words(STOP_DENSITY) and (b.article or b.words >= LONG_WORDS):
            decided.append(True)
        elif other and b.words >= LONG_WORDS:
            decided.append(True)
        else:
            decided.append(None)
    counts = [label is not None and (not marked or b.article and not b.unwanted) for b, label in zip(found, decided)]
    before, after = _nearest(counts), [len(found) - 1 - j if j >= 0 else -1 for j in reversed(_nearest(counts[::-1]))]
    out = []
    for i, label in enumerate(decided):
        if label is None:
            a, b = before[i], after[i]
            if a < 0 and b < 0:
                label = marked
            elif a < 0 or b < 0:
                label = decided[max(a, b)]
            else:  # of two as near, kept wins
                label = decided[a] or decided[b] if i - a == b - i else decided[a if i - a < b - i else b]
        out.append(label)
    return out


def _nearest(counts: list[bool]) -> list[int]:
    """The last place up to each that counts, or -1."""
    out, last = [], -1
    for i, c in enumerate(counts):
        last = i if c else last
        out.append(last)
    return out


def main_text(html: str) -> str:
    found = settled(read(html))
    return "\n".join(b.text for b, keep in zip(found, labels(found)) if keep)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = [main_text(h) for h in strings(part.column("html")).to_pylist()]
            size = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), size], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    rows = bounded(pages).select(col("page_id").cast("bigint").alias("page_id"), col("url").cast("string").alias("url"), col("html").alias("html"))
    return rows.mapInArrow(_run, "page_id bigint, url string, text string, n_chars bigint")
