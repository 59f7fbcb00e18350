"""One page's markup as text blocks in page order and as the elements of the site's style tree that hold them.

Every step is linear in the page: a tag's end is found without going back, and places of open elements are
kept by tag, so neither unclosed tags nor quotes nor deep nesting cost more than their length.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

_NAME = r"<(/?)([a-zA-Z][^\s/>]*+)"
#: A tag up to the > outside quotes, and up to the first one, where a quote isn't closed.
_TAG = re.compile(_NAME + r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(_NAME + r"([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?""")
_DIGITS = re.compile("[0-9]+")
_NAME_PART = re.compile(r"[a-z]+")

#: Fixed values of the markup language, and words that class, id and role give to what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style title textarea iframe template noembed noframes".split())
ENDS_PARAGRAPH = BLOCK - {"option", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "head", "html"}
#: A tag closes an open one of its group, if no tag of the second set stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
FORM_TAGS = frozenset("form button select dialog search".split())
CHROME_TAGS = frozenset("nav footer aside menu".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar sidebars aside cookie cookies consent gdpr notice notices notification popup modal overlay comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager widget widgets toolbar skip copyright disclaimer contentinfo complementary".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: A name of several parts says what such a word says only if its other parts are these; has-sidebar, related-work or comments-open don't.
FILLER_WORDS = frozenset(
    "area bar block body bottom box buttons col column container content desktop footer global group header icons inner item items left links list main mobile outer page post posts primary right secondary section side site top wrap wrapper".split()
)
#: What markup says about a block. GONE: of a form, never text; NAMED: in an article, but named as something else.
GONE, COMMENTS, CHROME, NAMED, NEUTRAL, MAIN, ARTICLE = range(7)
#: Levels of block elements that are branches of their own; what is deeper belongs to the last one.
LEVELS = 64


@dataclass
class Block:
    branches: list[int]  # paths of the block elements around it, from the outermost to its own
    plain: list[int]  # the same by tags alone
    state: int
    text: str


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    elements: dict[tuple[int, int], set[tuple[int, int]]] = field(default_factory=dict)  # path and plain path: how its elements present their children, with names and by tags alone


@lru_cache(maxsize=1 << 14)
def _hash(above: int, step: str) -> int:
    return int.from_bytes(hashlib.blake2b(above.to_bytes(8, "little", signed=True) + step.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _names(attributes: str) -> str:
    """Values of class, id and role, lowered."""
    return " ".join((m[2] or "").strip("\"'").lower() for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role"))


@dataclass(eq=False)
class Named:
    """An element outside articles that is named as what isn't the article, whether it holds one, and the next such element around it."""

    comments: bool
    holds: bool
    around: Named | None


@lru_cache(maxsize=1 << 13)
def _words(names: str) -> frozenset[str]:
    """Words that whole names stand for: of a name's parts all are fillers, or all but words of CHROME_WORDS."""
    found: set[str] = set()
    for name in names.split():
        parts = set(_NAME_PART.findall(name))
        if parts <= CHROME_WORDS | FILLER_WORDS:
            found |= parts & CHROME_WORDS or parts & {"header"}
    return frozenset(found)


def _tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, slash, tag, attributes) of each tag; at last the text after them. Comments and declarations are tags without a name."""
    at = begin = 0
    quotes, close = True, -1
    while (start := page.find("<", at)) >= 0:
        following = page[start + 1 : start + 2]
        if following in ("!", "?"):
            closing = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(closing, start + len(closing) + 1)
            yield page[begin:start], "", "", ""
            at = begin = len(page) if end < 0 else end + len(closing)
            continue
        if not (following == "/" or following.isascii() and following.isalpha()):
            at = start + 1
            continue
        if close < start and (close := page.find(">", start)) < 0:
            break
        m = _TAG.match(page, start) if quotes else None
        if not m and (m := _PLAIN_TAG.match(page, start)) and ('"' in m[3] or "'" in m[3]):
            quotes = False  # an open quote: no later tag looks for its end again
        if not m:
            at = start + 1
            continue
        yield page[begin:start], m[1], m[2].lower(), m[3]
        at = begin = m.end()
        if not m[1] and m[2].lower() in RAW and (not m[3].endswith("/") or m[2].lower() in ("script", "style", "title", "textarea")):
            end = re.compile(rf"</{m[2]}(?=[\s/>])", re.I).search(page, at)
            last = page.find(">", end.end()) if end else -1
            at = begin = len(page) if last < 0 else last + 1
    yield page[begin:], "", "", ""


@dataclass(eq=False)
class _Element:
    tag: str
    block: bool
    state: int
    branches: list[int]
    plain: list[int]
    named: Named | None
    children: list[tuple[str, str]]  # each with its names, and its tag


def _state(tag: str, names: str, above: int, named: Named | None) -> tuple[int, Named | None]:
    if above == GONE or tag in FORM_TAGS:
        return GONE, named
    if above in (COMMENTS, CHROME):
        return above, named
    words = _words(names) if names and tag not in ("html", "body") else frozenset()
    is_main, is_comments = tag == "main" or "main" in names.split(), bool(words & COMMENT_WORDS)
    if tag in CHROME_TAGS:
        return COMMENTS if is_comments else CHROME, named
    if tag == "article" or is_main:
        wrapper = named
        while wrapper and not wrapper.holds:  # what is around one that holds an article does so, too
            wrapper.holds = True
            wrapper = wrapper.around
        if tag == "article" and is_comments and above != ARTICLE:
            named = Named(True, True, named)
    if above in (ARTICLE, NAMED):
        if tag not in ("article", "main") and is_comments:
            return COMMENTS, named
        return NAMED if above == NAMED or (tag not in ("article", "main") and words - {"header"}) else ARTICLE, named
    if tag == "article":
        return ARTICLE, named
    if is_main:
        return MAIN, named
    if words - {"header"} or (above < MAIN and (tag == "header" or words)):
        named = Named(is_comments, False, named)
    return above, named


def _worst(named: Named | None, best: int, known: dict[int, int]) -> int:
    """The least state that the named elements around a block give it: those that hold no article, or hold one beside a better one."""
    todo = []
    while named and id(named) not in known:
        todo.append(named)
        named = named.around
    worst = known[id(named)] if named else ARTICLE
    for w in reversed(todo):
        if not (w.holds and best < (MAIN if w.comments else ARTICLE)):
            worst = min(worst, COMMENTS if w.comments else CHROME)
        known[id(w)] = worst
    return worst


def parsed(page: str) -> Page:
    """The page's blocks that have text; white space in a block is one space, references are decoded."""
    out = Page()
    root = _Element("", True, NEUTRAL, [], [], None, [])
    stack, blocks, places = [root], [0], {"": [0]}  # open elements, places of the block elements among them, places by tag
    found: list[tuple[_Element, int, str, Named | None]] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined and stack[-1].state != GONE:
                found.append((stack[blocks[-1]], stack[-1].state, joined, stack[-1].named))

    def close(depth: int) -> None:
        if blocks[-1] >= depth:
            flush()
        while len(stack) > depth:
            element = stack.pop()
            places[element.tag].pop()
            if element.block:
                blocks.pop()
                if element.branches:
                    styles = tuple(_hash(len(element.children), " ".join(c[k] for c in element.children)) for k in range(2))
                    out.elements.setdefault((element.branches[-1], element.plain[-1]), set()).add(styles)

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    for before, slash, tag, attributes in _tokens(page):
        if before:
            text.append(html.unescape(before) if "&" in before else before)
        if not tag:
            continue
        block = tag in BLOCK
        if slash:
            if block:
                flush()
            at = last((tag,))
            if at > 0 and (block or at > blocks[-1]):
                close(at)
            continue
        if tag in RAW:
            continue
        if tag in VOID:
            stack[-1].children.append((tag, tag))
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in ENDS_PARAGRAPH and (at := last(("p",))) > 0 and at == blocks[-1]:
            close(at)
        if tag in CLOSES:
            same, scope = CLOSES[tag]
            if (at := last(same)) > last(scope) and at > 0:
                close(min(places[t][-1] for t in same if places.get(t) and places[t][-1] > last(scope)))
        if block:
            flush()
        above = stack[-1]
        names = _names(attributes) if attributes and not attributes.isspace() else ""
        state, named = _state(tag, names, above.state, above.named)
        if state != above.state or named is not above.named:
            flush()
        if attributes.endswith("/") and not block:
            continue
        step = f"{tag}.{_DIGITS.sub('', names)}" if names else tag
        above.children.append((step, tag))
        branches, plain = above.branches, above.plain
        if block and tag not in ("html", "body") and len(branches) < LEVELS:
            branches, plain = [*branches, _hash(branches[-1] if branches else 0, step)], [*plain, _hash(plain[-1] if plain else 1, tag)]
        places.setdefault(tag, []).append(len(stack))
        if block:
            blocks.append(len(stack))
        stack.append(_Element(tag, block, state, branches, plain, named, []))
    close(1)
    flush()
    # a named element that holds the page's article is a wrapper, whatever its name; beside another article, it is what its name says
    best = max((state for _, state, _, named in found if not named), default=CHROME)
    known: dict[int, int] = {}
    for own, state, words, named in found:
        out.blocks.append(Block(own.branches or [0], own.plain or [1], min(state, _worst(named, best, known)), words))
    return out
