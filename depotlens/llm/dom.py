"""Leaf blocks of web pages: their text and the elements around them."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

# A comment, a self-closed drawing, a raw-text element with what it holds, any other markup declaration, or a tag. Quoted values may hold ">".
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg\b(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*/>"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg)\b(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>\"'<]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>",
    re.DOTALL | re.IGNORECASE)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")

# Elements that do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split())
# Elements without content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that a new block of the same kind ends.
_SELF_ENDING = frozenset("p li dt dd tr td th option".split())


class Block(NamedTuple):
    text: str
    tags: tuple[str, ...]  # from the root to the block
    names: tuple[str, ...]  # words of their class, id and role attributes
    linked: int  # characters inside links
    above: tuple[tuple[int, str, tuple[str, ...]], ...] = ()  # number on the page, tag and names of every open element


def blocks(html: str) -> list[Block]:
    """Texts between block-level tags, in page order; those without text are left out.

    Character references are decoded and white space is unified. Scripts, styles, comments and markup have no text.
    """
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    parts: list[str] = []
    state = {"linked": 0, "link": 0}

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        linked, state["linked"] = state["linked"], 0
        if text:
            inside = [x for x in stack if x[0] not in INLINE]
            found.append(Block(text, tuple(t for t, _, _ in inside), tuple(n for _, names, _ in stack for n in names), linked,
                               tuple((k, t, names) for t, names, k in stack)))

    def add(raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if state["link"]:
                state["linked"] += len(text)

    def leave(at: int) -> None:
        state["link"] -= sum(t == "a" for t, _, _ in stack[at:])
        del stack[at:]

    at = 0
    for m in _MARKUP.finditer(html):
        add(html[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
            continue
        if tag in _SELF_ENDING:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in _VOID or m["attributes"].endswith("/"):
            continue
        given = [a or b or c for _, a, b, c in _NAMES.findall(m["attributes"])] if m["attributes"] else []
        stack.append((tag, tuple(p for g in given for p in _PART.findall(g.lower())), m.start()))
        state["link"] += tag == "a"
    add(html[at:])
    flush()
    return found
