"""Leaf blocks of a page: runs of text between block-level tags, with the elements around them.

A forgiving reader: comments, scripts and styles go, character references are decoded, elements that a new one closes are
closed, stray end tags are passed over, and what is open at the end of the page just ends. Inline elements and line breaks
don't end a block; all white space in a block becomes single spaces.

Tags are read as browsers read them: a name goes up to white space, a slash or the end of the tag, then come attributes, whose
names may hold any other character, stray quotes too. A quote that is never closed is a part of its value, which then ends at
white space, so that the rest of the page isn't lost. A comment, script or style without an end goes on to the end of the page.
Elements whose content a browser would not show as text (object, svg, math, noscript and others) are read like any other; the
field may judge them by their names.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

#: Elements without content, elements whose content is no text, block-level elements, and what closes what.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = {name: re.compile(rf"</{name}(?=[ \t\n\f\r/>])[^>]*(?:>|\Z)", re.I) for name in ("script", "style")}
BLOCK = frozenset(
    "html head title body address article aside blockquote button center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre section select summary table caption thead tbody tfoot "
    "tr td th textarea ul".split()
)
CLOSES_P = BLOCK - frozenset("html head title body button option select legend summary caption thead tbody tfoot tr td th textarea li dd dt".split())
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = frozenset("ul ol dl table div section article aside nav header footer main form body select td th blockquote".split())

WHITE = r"[ \t\n\f\r]"
#: An attribute: its name, then perhaps its value, between quotes or up to white space. Nothing is ever tried twice.
ATTRIBUTE = rf"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:{WHITE}*+={WHITE}*+(?:\"([^\"]*+)\"|'([^']*+)'|([^ \t\n\f\r>]*+)))?+"
TAG = rf"<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|{re.sub(r'[(](?=[^?])', '(?:', ATTRIBUTE)})*+)(?:>|\Z)"
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|{TAG}", re.S)
ATTRIBUTES = re.compile(ATTRIBUTE)
#: Attributes whose words count, and those that may hide an element.
NAMING, HIDING = frozenset("class id role itemprop".split()), frozenset("hidden aria-hidden style".split())
OF_INTEREST = re.compile("class|id|role|itemprop|style", re.I)
PARTS = re.compile(r"[a-z]+")


class Block(NamedTuple):
    text: str
    #: Of each element around it, from the outside: its name, and words of its class, id and role.
    path: tuple[tuple[str, frozenset], ...]
    #: Characters inside links.
    linked: int


def names(attributes: str) -> frozenset:
    if not attributes or not OF_INTEREST.search(attributes):
        return frozenset()
    found = set()
    for name, *values in ATTRIBUTES.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in HIDING:
            if value != "false" if name != "style" else "display:none" in value.replace(" ", ""):
                found.add("hidden")
        elif name in NAMING:
            found.update(PARTS.findall(value))
    return frozenset(found)


def blocks(html: str | None) -> list[Block]:
    """The blocks that have any text, in page order. Null or empty: none."""
    html = html or ""
    out: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    parts: list[str] = []
    linked = links = at = 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple(stack), linked))
            parts, linked = [], 0

    def text(piece: str):
        nonlocal linked
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if links:
                linked += len(piece)

    def close(depth: int):
        nonlocal links
        if any(name in BLOCK for name, _ in stack[depth:]):
            flush()
        links -= sum(name == "a" for name, _ in stack[depth:])
        del stack[depth:]

    def close_open(closed: set[str]):
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in closed:
                return close(depth)
            if stack[depth][0] in LIMITS:
                return None

    while m := TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK and not any(x == name for x, _ in stack):
                flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
                if stack[depth][0] in LIMITS and name not in BLOCK:
                    break
            continue
        if name in NO_TEXT:
            end = NO_TEXT[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P:
                close_open({"p"})
            if name in CLOSED_BY:
                close_open(CLOSED_BY[name])
        if name in VOID or name not in BLOCK and m[3].endswith("/") and ATTRIBUTES.sub("", m[3]).endswith("/"):
            continue
        stack.append((name, names(m[3])))
        links += name == "a"
    text(html[at:])
    flush()
    return out
