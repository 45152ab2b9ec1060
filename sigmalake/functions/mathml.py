"""MathML text to trees and back."""

from __future__ import annotations

import re

from .mathtree import ELEMENT, TEXT, MathError, Node, element, text

_PART = re.compile(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[(?P<raw>.*?)\]\]>|<(?P<close>/)?(?P<tag>[A-Za-z][\w:.-]*)[^<>]*?(?P<empty>/)?>|(?P<text>[^<]+)", re.S)
_CHAR = re.compile(r"&(?:#x([0-9A-Fa-f]+)|#(\d+)|(lt|gt|amp|quot|apos));")
_XML = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def _decoded(s: str) -> str:
    """Character references and the entities of XML itself; any other entity stays as it is written."""
    return _CHAR.sub(lambda m: _XML[m[3]] if m[3] else chr(int(m[1], 16) if m[1] else int(m[2])), s)


def parse(mathml: str) -> Node:
    """The tree of the first element; attributes are dropped.

    Characters count when an element ends, so those before a child element are
    the child's.
    """
    open_: list[tuple[str, list[Node]]] = [("", [])]
    waiting: list[str] = []
    at = 0
    for m in _PART.finditer(mathml):
        if m.start() != at:
            raise MathError(f"no markup at {mathml[at:at + 20]!r}")
        at = m.end()
        if m["raw"] is not None:
            waiting.append(m["raw"])
        elif m["text"] is not None:
            waiting.append(_decoded(m["text"]))
        elif m["tag"]:
            if not m["close"]:
                open_.append((m["tag"], []))
            if m["close"] or m["empty"]:
                tag, children = open_.pop()
                if tag != m["tag"]:
                    raise MathError(f"<{tag}> ended by </{m['tag']}>")
                if characters := "".join(waiting).strip():
                    children.append(text(characters))
                waiting.clear()
                open_[-1][1].append(element(tag, *children))
    if at != len(mathml) or len(open_) != 1 or not open_[0][1]:
        raise MathError("not a whole element")
    return open_[0][1][0]


_PLAIN_AMP = re.compile(r"&(?![A-Za-z]+;)")


def render(node: Node) -> str:
    """Markup of a tree as it was read."""
    if node.kind == TEXT:
        return _PLAIN_AMP.sub("&amp;", node.name).replace("<", "&lt;").replace(">", "&gt;")
    if node.kind != ELEMENT:
        raise MathError("only a tree as it was read has markup")
    return f"<{node.name}>{''.join(map(render, node.children))}</{node.name}>"
