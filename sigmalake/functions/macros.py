r"""LaTeX definitions: \newcommand, \renewcommand, \providecommand, \def, \let and \DeclareMathOperator, expanded over tokens.

A definition holds for the rest of its formula and for the later formulas of its
page. Arguments are groups or single tokens; \newcommand's first one may have a
default, \def's may end at given tokens. Expansion is bounded in depth and in
tokens: what goes beyond, or is not well-formed, is an error of its formula.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .mathtree import MathError

#: Expansions within expansions, and tokens that a formula's expansion may take.
MAX_DEPTH, MAX_TOKENS = 64, 100_000

_TOKEN = re.compile(r"%[^\n]*(?:\n|$)|(\\[A-Za-z]+|\\.|#[0-9]|\s+|.)", re.S)
DEFINING = ("newcommand", "renewcommand", "providecommand", "def", "let", "DeclareMathOperator")
_DEFINES = re.compile(rf"\\(?:{'|'.join(DEFINING)})(?![A-Za-z])")


@dataclass(frozen=True)
class Macro:
    """``pattern``: parameters (#1 ...) and the tokens between them; ``default``: of an optional first one."""

    pattern: tuple[str, ...]
    body: tuple[str, ...]
    default: tuple[str, ...] | None = None


def tokens(latex: str) -> list[str]:
    return [m[1] for m in _TOKEN.finditer(latex) if m[1]]


def joined(parts: list[str]) -> str:
    """Tokens as text; a command keeps apart from a letter that follows."""
    out: list[str] = []
    for t in parts:
        if out and t[0].isalpha() and len(out[-1]) > 1 and out[-1][0] == "\\" and out[-1][1].isalpha():
            out.append(" ")
        out.append(t)
    return "".join(out)


class _Input:
    """Tokens still to be read, each with the depth of the expansion that it comes from; the next one is the last of the list."""

    def __init__(self, source: list[str]):
        self.rest = [(t, 0) for t in reversed(source)]
        self.read = 0

    def push(self, parts, depth: int) -> None:
        if depth > MAX_DEPTH:
            raise MathError("macros are nested too deeply")
        self.rest += [(t, depth) for t in reversed(parts)]

    def next(self) -> tuple[str, int]:
        if not self.rest:
            raise MathError("a macro's formula ends early")
        self.read += 1
        if self.read > MAX_TOKENS:
            raise MathError("macros expand to too much")
        return self.rest.pop()

    def peek(self) -> str:
        """The next token that is no space; spaces before it are gone."""
        while self.rest and self.rest[-1][0].isspace():
            self.rest.pop()
        return self.rest[-1][0] if self.rest else ""

    def balanced(self, ends: tuple[str, ...]) -> list[str]:
        """Tokens up to ``ends``, which are read too; braces between hold together."""
        out: list[str] = []
        depth = 0
        while True:
            if depth == 0 and tuple(t for t, _ in self.rest[: -len(ends) - 1 : -1]) == ends:
                del self.rest[-len(ends) :]
                return out
            t, _ = self.next()
            depth += (t == "{") - (t == "}")
            if depth < 0:
                raise MathError("} without { in a macro's argument")
            out.append(t)

    def argument(self) -> list[str]:
        if self.peek() == "{":
            self.next()
            return self.balanced(("}",))
        return [self.next()[0]]

    def optional(self) -> list[str] | None:
        if self.peek() != "[":
            return None
        self.next()
        return self.balanced(("]",))

    def name(self) -> str:
        own = [t for t in self.argument() if not t.isspace()]
        if len(own) != 1 or len(own[0]) < 2 or own[0][0] != "\\":
            raise MathError("a definition needs a command's name")
        return own[0]


def _define(source: _Input, how: str, macros: dict[str, Macro]) -> None:
    if source.peek() == "*":
        source.next()
    name = source.name()
    if how == "let":
        if source.peek() == "=":
            source.next()
        source.peek()
        other = source.next()[0]
        macros[name] = macros.get(other, Macro((), (other,)))
        return
    if how == "def":
        pattern = []
        while source.peek() != "{":
            pattern.append(source.next()[0])
        numbers = [t for t in pattern if re.fullmatch("#[0-9]", t)]
        if numbers != [f"#{k}" for k in range(1, len(numbers) + 1)]:
            raise MathError("parameters out of order")
        macros[name] = Macro(tuple(pattern), tuple(source.argument()))
        return
    if how == "DeclareMathOperator":
        macros[name] = Macro((), ("\\operatorname", "{", *source.argument(), "}"))
        return
    count = "".join(source.optional() or ["0"]).strip()
    if not re.fullmatch("[0-9]", count):
        raise MathError("a macro has up to nine parameters")
    default = source.optional()
    macro = Macro(tuple(f"#{k}" for k in range(1, int(count) + 1)), tuple(source.argument()), None if default is None else tuple(default))
    if how != "providecommand" or name not in macros:
        macros[name] = macro


def _arguments(source: _Input, macro: Macro) -> list[list[str]]:
    out: list[list[str]] = []
    k = 0
    if macro.default is not None and macro.pattern:
        given = source.optional()
        out.append(list(macro.default) if given is None else given)
        k = 1
    while k < len(macro.pattern):
        t = macro.pattern[k]
        k += 1
        if not re.fullmatch("#[0-9]", t):
            source.peek()
            if source.next()[0] != t:
                raise MathError("a macro is not used as defined")
            continue
        ends = []
        while k < len(macro.pattern) and not re.fullmatch("#[0-9]", macro.pattern[k]):
            ends.append(macro.pattern[k])
            k += 1
        out.append(source.balanced(tuple(ends)) if ends else source.argument())
    return out


def expand(latex: str, macros: dict[str, Macro] | None = None) -> str:
    """``latex`` without definitions and with all macros expanded; what it defines is added to ``macros``."""
    macros = {} if macros is None else macros
    if not macros and not _DEFINES.search(latex):
        return latex
    source, out = _Input(tokens(latex)), []
    while source.rest:
        t, depth = source.next()
        if t[0] == "\\" and t[1:] in DEFINING:
            _define(source, t[1:], macros)
        elif t in macros:
            macro = macros[t]
            if t[-1].isalpha():
                source.peek()  # the spaces after a command's name are none of the formula's
            own = _arguments(source, macro)
            body: list[str] = []
            for x in macro.body:
                if re.fullmatch("#[0-9]", x):
                    if int(x[1:]) > len(own) or x == "#0":
                        raise MathError("a macro has no such parameter")
                    body += own[int(x[1:]) - 1]
                else:
                    body.append(x)
                if len(body) > MAX_TOKENS:
                    raise MathError("macros expand to too much")
            source.push(body, depth + 1)
        else:
            out.append(t)
    return joined(out).strip()


def expand_page(formulas: list[str]) -> list[str]:
    """The formulas of a page in order, expanded. One that cannot be is left as it is, to be an error where it is read."""
    if not any(_DEFINES.search(f) for f in formulas):
        return formulas
    macros: dict[str, Macro] = {}
    out = []
    for f in formulas:
        try:
            out.append(expand(f, macros))
        except MathError:
            out.append(f)
    return out


def expanded(formulas: Column) -> Column:
    """``expand_page`` of an array column, in one Arrow-batched pass without a shuffle; null stays null."""

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: p if p is None else expand_page([f or "" for f in p]))

    return F.pandas_udf(run, "array<string>").asNondeterministic()(formulas)
