"""Pages cut into blocks of text, each with the part of the page it stands in."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Parts of a page: chrome by its markup, inside the article, and neither.
CHROME, ARTICLE, LOOSE = 0, 1, 2

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]{0,10000}\"|'[^']{0,10000}'){0,200}+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Elements whose content is text up to their own end tag.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "title", "textarea", "iframe", "noscript", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: Elements that are no part of an article wherever they stand.
_CHROME = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input label map menu nav noscript object script select style "
    "svg template textarea title video".split()
)
#: Words in class, id or role that name chrome; those in the second list only outside the article.
_CHROME_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup "
    "modal newsletter subscribe signup login sidebar navbar nav navigation menu breadcrumb breadcrumbs comment comments commentlist "
    "disqus replies respond sharing share social related recommended recommendations pagination pager footer banner contentinfo "
    "complementary".split()
)
_CHROME_OUTSIDE = frozenset("header masthead notice alert widget toolbar search overlay side topbar bottombar legal copyright".split())
#: A class such as ``has-sidebar`` says what is next to its element.
_ABOUT = frozenset("has with without no is".split())


class Block(NamedTuple):
    text: str
    part: int
    place: str  # innermost elements, as a token of the page's structure


def _zone(name: str, attributes: str, parent: int) -> int:
    if parent == CHROME or name in _CHROME or (name == "header" and parent != ARTICLE):
        return CHROME
    zone = ARTICLE if name in ("article", "main") else parent
    if not attributes.strip() or name in ("html", "body"):
        return zone
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            return CHROME
        if key == "role" and value.lower() in ("main", "article"):
            zone = ARTICLE
        elif key == "itemprop" and value.lower() == "articlebody":
            zone = ARTICLE
        elif key in ("class", "id", "role") and name != "main":
            for token in value.split():
                named = {w.lower() for w in _WORDS.findall(token)}
                if not named & _ABOUT and (named & _CHROME_WORDS or (zone == LOOSE and named & _CHROME_OUTSIDE)):
                    return CHROME
    return zone


def blocks(page: str) -> list[Block]:
    """Texts of the blocks of a page in order, references decoded and white space made one space.

    Comments, scripts, styles and markup are gone. Missing end tags, end tags without a start, a page
    cut off anywhere and text without any markup are all read as far as they go.
    """
    found: list[Block] = []
    stack: list[tuple[str, int, str]] = [("", LOOSE, "")]
    depth: dict[str, int] = {}
    texts: list[str] = []

    def close_block() -> None:
        if texts:
            # White space between tags only separates blocks.
            text = " ".join(html.unescape("".join(texts)).split())
            texts.clear()
            if text:
                found.append(Block(text, stack[-1][1], stack[-2][2] + ">" + stack[-1][2] if len(stack) > 1 else ""))

    def close(name: str) -> None:
        while True:
            last = stack.pop()[0]
            depth[last] -= 1
            if last == name:
                return

    at = 0
    while True:
        match = _MARKUP.search(page, at)
        if not match:
            texts.append(page[at:])
            break
        if match.start() > at:
            texts.append(page[at : match.start()])
        at = match.end()
        ending, name, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if not name:
            continue
        name = name.lower()
        if name == "br":
            texts.append(" ")
            continue
        zone = CHROME if name in _RAW else None
        boundary = name in _BLOCK
        if not boundary and not ending and zone is None and name not in _VOID:
            zone = _zone(name, attributes, stack[-1][1])
            boundary = zone != stack[-1][1]  # chrome inside a line is a block of its own
        if ending and depth.get(name) and not boundary:
            boundary = next(z for n, z, _ in reversed(stack) if n == name) != stack[-1][1] or stack[-1][1] != stack[-2][1]
        if boundary:
            close_block()
        if ending:
            if depth.get(name):
                close(name)
            continue
        if name in _RAW:
            end = _RAW[name].search(page, at)
            stop = page.find(">", end.end()) if end else -1
            at = stop + 1 if stop >= 0 else len(page)
            continue
        if name in _BLOCK and depth.get("p"):
            close("p")
        if name in ("li", "option", "tr", "td", "th", "dt", "dd") and stack[-1][0] == name:
            close(name)
        if name in _VOID or attributes.rstrip().endswith("/") and name not in _BLOCK:
            continue
        zone = _zone(name, attributes, stack[-1][1]) if zone is None else zone
        stack.append((name, zone, name))
        depth[name] = depth.get(name, 0) + 1
    close_block()
    return found
