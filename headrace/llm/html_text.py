"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides what it
can: blocks inside menus, footers, adverts, forms and the like, and blocks made
of links, are boilerplate; longer blocks with enough stop words and few links
are content; all others stay open. Where no block of a page has enough stop words
(a language without a list) length and links decide alone. In the second pass an
open block inherits the label of the nearest decided block of its own section (the
innermost article or main element, else the body), the earlier one on a tie; a
section without a decided block is content if it is an article or main element.

Work is linear in the page: what an end tag ends is looked up by name.

Defined cases: null or empty html has no text; unclosed elements end with their
parent or the page; tags inside scripts, styles and comments are not markup; a
quote counts only at the start of an attribute's value; an unended comment or
script runs to the end; repeated pages are handled row by
row; other columns pass through, one called like the result is replaced.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import add_column

#: Words of a block that decides by itself, least share of stop words, most share of characters in links.
LONG_WORDS, STOP_SHARE, LINK_SHARE = 15, 0.15, 0.4

# Element names by their role.
RAW = set("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = set("nav footer aside form head menu select button dialog header option object audio video canvas fieldset".split())
SECTION = {"article", "main"}
#: An open element of the first kind is ended by a start tag of the second.
ENDS = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: Words in class, id or role attributes that mark boilerplate.
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc sidebar aside widget widgets related recommended recommendations share sharing social "
    "footer header masthead topbar copyright legal disclaimer comment comments commentlist disqus respond reply replies login signup subscribe newsletter search form toolbar "
    "complementary contentinfo hidden skip".split()
)

# Common function words of English, German, French and Spanish.
STOP = set(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has "
    "when who will more no if out so said what up its about into than them can only other new some could time these two may then do "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou aux cette mais comme nous vous elle leur était être fait ont ses tout on "
    "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=(?:\s*(?:\"[^\"]*\"|'[^']*'))?+)*+)(?:>|\Z)", re.S)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[^\W\d_]+")
#: Letters of scripts that put no spaces between words; two of them count as a word.
_DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}


@dataclass
class Block:
    section: int
    bad: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    label: bool | None = None
    text: str = ""


def marked(attributes: str) -> bool:
    """Do class, id, role or visibility say boilerplate?"""
    if not attributes or attributes.isspace():
        return False
    names = " ".join(m[1] for m in _MARK.finditer(attributes)).lower()
    return bool(names and not MARKS.isdisjoint(re.split(r"[^a-z]+", names))) or bool(_HIDDEN.search(attributes))


def cut_blocks(page: str) -> tuple[list[Block], dict[int, bool]]:
    """Blocks with text in page order, and for each section whether it is an article or main element."""
    found: list[Block] = []
    sections = {0: False}
    #: name, boilerplate, section, link of each open element
    stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]
    now = Block(0, False)

    def flush() -> None:
        nonlocal now
        if now.parts:
            found.append(now)
        now = Block(stack[-1][2], stack[-1][1])

    #: Places of open elements: of each name, of block elements, of article and main elements.
    places: dict[str, list[int]] = {}
    opened, inner = [], [0]

    def close(to: int) -> None:
        block = any(x[0] in BLOCK or x[1] != stack[to - 1][1] for x in stack[to:])
        if block:
            flush()
        for x in stack[to:]:
            places[x[0]].pop()
        del stack[to:]
        for of in (opened, inner):
            while of and of[-1] >= to:
                of.pop()
        if block:
            flush()

    def add(text: str) -> None:
        if text:
            now.parts.append(text)
            if stack[-1][3]:
                now.linked += len("".join(text.split()))

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if not places.get(name):
                if name in BLOCK and len(inner) < 2:
                    flush()
            elif places[name][-1] >= inner[-1] or name in SECTION | {"body", "html"}:
                close(places[name][-1])
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = _RAW_END[name].search(page, at)
                at = len(page) if end is None else (page.find(">", end.start()) + 1 or len(page))
            continue
        while len(stack) > 1 and name in ENDS.get(stack[-1][0], ()):
            close(len(stack) - 1)
        if name in BLOCK and opened and stack[opened[-1]][0] == "p":
            close(opened[-1])
        _, bad, section, link = stack[-1]
        if name in VOID:
            if name == "br":
                now.parts.append(" ")
            elif name == "hr":
                flush()
            continue
        own = (name in BOILERPLATE and not (name == "header" and sections[section])) or marked(m[3])
        if name in {"html", "body", *SECTION}:
            own = False
        if name in BLOCK or own:
            flush()
        if name in SECTION and not bad:
            section = len(sections)
            sections[section] = True
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            opened.append(len(stack))
        if name in SECTION:
            inner.append(len(stack))
        stack.append((name, bad or own, section, link or name == "a"))
        if name in BLOCK or own:
            now = Block(section, bad or own)
    add(page[at:])
    flush()
    return found, sections


def main_text(page: str | None) -> str:
    """Blocks labelled as content, joined by a space."""
    if not page:
        return ""
    blocks, sections = cut_blocks(page)
    kept: list[Block] = []
    for b in blocks:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
        if b.text:
            kept.append(b)
    long = []
    for b in kept:
        words = _WORD.findall(b.text.lower())
        links = b.linked / max(1, len(b.text) - b.text.count(" "))
        if b.bad or links > LINK_SHARE:
            b.label = False
        elif len(words) >= LONG_WORDS and sum(w in STOP for w in words) >= STOP_SHARE * len(words):
            b.label = True
        elif len(words) >= LONG_WORDS or not b.text.isascii() and len(words) + len(_DENSE.findall(b.text)) // 2 >= LONG_WORDS:
            long.append(b)
    if not any(b.label for b in kept):
        for b in long:
            b.label = True
    decided: dict[int, list[int]] = {}
    for i, b in enumerate(kept):
        if b.label is not None and not b.bad:
            decided.setdefault(b.section, []).append(i)
    out, place = [], dict.fromkeys(decided, 0)
    for i, b in enumerate(kept):
        if b.label is None:
            near = decided.get(b.section)
            if not near:
                b_label = sections[b.section]
            else:
                k = place[b.section]
                while k + 1 < len(near) and abs(near[k + 1] - i) < abs(near[k] - i):
                    k += 1
                place[b.section] = k
                b_label = bool(kept[near[k]].label)
        else:
            b_label = b.label
        if b_label:
            out.append(b.text)
    return " ".join(out)


def extract_text(pages: DataFrame, name: str = "text", column: str = "html") -> DataFrame:
    """``pages`` with the main text of each page in a string column ``name``."""

    def run(batch: pa.RecordBatch) -> pa.Array:
        return pa.array([main_text(x) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()], pa.string())

    return add_column(pages, name, "string", column, run)
