"""Expression trees of Presentation MathML, their three rewrites and their subtree terms.

A node is immutable. ``kind`` is TEXT (characters), ELEMENT (a tag with
children), LEAF (an identifier, number or string with its text) or OPERATOR (an
operator symbol with its operands as children). The string of a tree serves as
its identity, its order and, for subtrees, as index term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

TEXT, ELEMENT, LEAF, OPERATOR = "text", "element", "leaf", "operator"


class MathError(ValueError):
    """A formula that cannot be read or normalised."""


class Node(NamedTuple):
    kind: str
    name: str  # tag; for an operator its symbol; for text the characters
    text: str = ""  # of a leaf
    children: tuple["Node", ...] = ()

    def wrap(self, inside: str) -> str:
        """The node's own markup around ``inside``."""
        if self.kind == TEXT:
            return self.name
        if self.kind == OPERATOR:
            return f"<mo o='{self.name}'>{inside}</mo>"
        return f"<{self.name}>{inside}</{self.name}>"

    def __str__(self) -> str:
        return self.wrap(self.text if self.kind == LEAF else "".join(map(str, self.children)))

    def outline(self) -> str:
        """The node without what it holds; text stays."""
        return self.wrap("")


def text(characters: str) -> Node:
    return Node(TEXT, characters)


def element(tag: str, *children: Node) -> Node:
    return Node(ELEMENT, tag, "", tuple(children))


def token(tag: str, characters: str) -> Node:
    """A token element as it is read, before clean-up."""
    return element(tag, text(characters))


def leaf(tag: str, characters: str) -> Node:
    return Node(LEAF, tag, characters)


def operator(symbol: str, *operands: Node) -> Node:
    return Node(OPERATOR, symbol, "", tuple(operands))


def order_key(node: Node) -> bytes:
    """Order by UTF-16 code units of the string."""
    return str(node).encode("utf-16-be", "surrogatepass")


# --- clean-up -------------------------------------------------------------

#: Token elements that become leaves or operators.
TOKENS = ("mi", "mn", "mo", "ms")
#: Elements whose places mean something, so that adjoining identifiers in them stay apart.
POSITIONAL = ("msup", "msub", "mfrac", "munderover", "mover", "munder", "msubsup", "mroot")


def _is_trailer(node: Node) -> bool:
    """Space, or a full stop that ends a formula."""
    if node.kind != ELEMENT:
        return False
    if node.name in ("mo", "mi") and node.children:
        first = node.children[0]
        if first.kind != TEXT:
            raise MathError(f"<{node.name}> holds an element")
        return first.name == "."
    return node.name == "mspace"


def _clean(node: Node) -> Node:
    if node.kind != ELEMENT:
        return node
    if node.name in TOKENS:
        if len(node.children) != 1 or node.children[0].kind != TEXT:
            raise MathError(f"<{node.name}> must hold text alone")
        characters = node.children[0].name
        return operator(characters) if node.name == "mo" else leaf(node.name, characters)
    joined: list[Node] = []
    for child in map(_clean, node.children):
        word = child.kind == LEAF and child.name == "mi"
        if word and joined and joined[-1].kind == LEAF and joined[-1].name == "mi" and node.name not in POSITIONAL:
            joined[-1] = leaf("mi", joined[-1].text + child.text)
        else:
            joined.append(child)
    if node.name == "mrow" and len(joined) == 1:
        return joined[0]
    return element(node.name, *joined)


def adjust(root: Node) -> Node:
    """Drops one trailing space or full stop, makes leaves and operators, joins adjoining identifiers, unwraps single rows."""
    if root.kind == ELEMENT and root.children and _is_trailer(root.children[-1]):
        root = root._replace(children=root.children[:-1])
    return _clean(root)


# --- operator precedence --------------------------------------------------

#: How tightly operators bind, lower first; + and - bind by SIGN where no operand stands before them.
PRIORITIES = {
    "+": 5, "-": 5, "&not;": 2, "*": 4, "/": 4, "%": 4, "mod": 4,
    "<": 6, ">": 6, "<=": 6, "&leq;": 6, "&GreaterEqual;": 6, ">=": 6,
    "==": 7, "!=": 7, "&vee;": 8, "&wedge;": 9,
}
SIGN = 2
LOOSEST = 100


def priority(symbol: str, after_operand: bool) -> int:
    if symbol in ("+", "-") and not after_operand:
        return SIGN
    return PRIORITIES.get(symbol, LOOSEST)


def _apply(symbol: str, arity: int, values: list[Node]) -> None:
    """Replaces the last values by the operator over them, as many of ``arity`` as there are."""
    at = max(0, len(values) - arity)
    values[at:] = [operator(symbol, *values[at:])]


def reconstruct(node: Node) -> Node:
    """Gives operators their operands by precedence, in every list of children.

    An operator takes as many operands as it has neighbours that are no
    operators. Whether a waiting + or - is a sign is judged from where the next
    operator stands. What no operator takes stays as a sibling.
    """
    if node.kind in (TEXT, LEAF):
        return node
    items = [reconstruct(c) for c in node.children]
    values: list[Node] = []
    waiting: list[tuple[str, int]] = []
    for i, item in enumerate(items):
        if item.kind != OPERATOR:
            values.append(item)
            continue
        operand_before = i > 0 and items[i - 1].kind != OPERATOR
        operand_after = i + 1 < len(items) and items[i + 1].kind != OPERATOR
        own = priority(item.name, operand_before)
        while waiting and priority(waiting[-1][0], operand_before) <= own:
            _apply(*waiting.pop(), values)
        waiting.append((item.name, operand_before + operand_after))
    while waiting:
        _apply(*waiting.pop(), values)
    return node._replace(children=tuple(values))


# --- commutative order ----------------------------------------------------

COMMUTATIVE = ("+", "*")


def reorder(node: Node) -> Node:
    """Puts the two operands of + and * in order, bottom up."""
    if not node.children:
        return node
    children = tuple(map(reorder, node.children))
    if node.kind == OPERATOR and node.name in COMMUTATIVE and len(children) == 2:
        children = tuple(sorted(children, key=order_key))
    return node._replace(children=children)


def normalise(root: Node, settings) -> Node:
    steps: list[tuple[bool, Callable[[Node], Node]]] = [
        (settings.adjust_tree, adjust),
        (settings.reconstruct_expression, reconstruct),
        (settings.reorder_operands, reorder),
        *((True, own) for own in settings.rewrites),
    ]
    for wanted, step in steps:
        if wanted:
            root = step(root)
    return root


# --- terms ----------------------------------------------------------------


class Term(NamedTuple):
    term: str
    level: int
    generalization: bool


#: Elements that only group: no markup of theirs in a term.
GROUPING = ("math", "mrow")


def terms(node: Node, generalise: bool = True, level: int = 1) -> Iterator[Term]:
    """A term for each subtree, its parent's first: the general form (children in outline), then the exact one.

    Leaves and texts of one character give no term, and neither does a formula
    that holds nothing but spaces. A group with one child is passed over, though
    its child is a level deeper.
    """
    if node.kind in (TEXT, LEAF):
        if len((node.text if node.kind == LEAF else node.name).encode("utf-16-be", "surrogatepass")) > 2:
            yield Term(str(node), level, False)
        return
    bare = node.kind == ELEMENT and node.name in GROUPING
    if not (bare and len(node.children) == 1):
        general, exact = "".join(c.outline() for c in node.children), "".join(map(str, node.children))
        if not bare:
            general, exact = node.wrap(general), node.wrap(exact)
        if generalise and general != exact:
            yield Term(general, level, True)
        if exact or level > 1:
            yield Term(exact, level, False)
    for child in node.children:
        yield from terms(child, generalise, level + 1)
