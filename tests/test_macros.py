import pytest

from sigmalake.functions import latex, macros
from sigmalake.functions.mathtree import MathError
from sigmalake.functions.terms import tree_of
from sigmalake.sources import wiki


@pytest.mark.parametrize(("source", "want"), [
    (r"\newcommand{\R}{\mathbb{R}} x \in \R", r"x \in \mathbb{R}"),
    (r"\def\half#1{\frac{#1}{2}}\half x + \half{a + b}", r"\frac{x}{2} + \frac{a + b}{2}"),
    (r"\newcommand\p[2][n]{#2_{#1}}\p{a}\p[k]{b}", r"a_{n}b_{k}"),
    (r"\def\pair<#1,#2>{(#2,#1)}\pair<a,{b,c}>", r"({b,c},a)"),
    (r"\newcommand{\a}{\b}\newcommand{\b}{c}\a\b d", "ccd"),
    (r"\let\x=\alpha\x y", r"\alpha y"), (r"\def\x{1}\let\y\x\def\x{2}\x\y", "21"),
    (r"\DeclareMathOperator{\rank}{rank}\rank A", r"\operatorname{rank} A"),
    (r"\newcommand{\x}{1}\providecommand{\x}{2}\providecommand{\y}{3}\x\y", "13"),
    (r"\newcommand{\x}[1]{\newcommand{\y}{#1}}\x{q}\y", "q"),
    (r"\def\x{\alpha}\x b % \x" + "\n c", r"\alpha b c"), (r"\newcommand {\x} [1] {<#1>} \x {a}", "<a>"), ("a + b", "a + b"),
])
def test_expansion(source, want):
    tokens = lambda x: [t for t in macros.tokens(x) if not t.isspace()]
    assert tokens(macros.expand(source)) == tokens(want)


@pytest.mark.parametrize("source", [
    r"\def\x{\x}\x", r"\def\x{\x\x}\x", r"\newcommand{\x}[1]{#2}\x{a}", r"\newcommand{\x}[2]{#1}\x{a}", r"\def\x#2{a}", r"\newcommand{ab}{c}", r"\newcommand{\x}[10]{a}",
    r"\def\x(#1){a}\x[b]", r"\def\x{", r"\newcommand{\x}[1]{#1#1#1#1}" + r"\x{" * 12 + "a" + "}" * 12,
])
def test_bounds_and_faults_are_errors(source):
    with pytest.raises(MathError):
        macros.expand(source)


def test_definitions_hold_for_later_formulas_of_the_page(spark):
    rows = [
        (1, r"<math>\x</math> <math>\def\x{a + b}</math> text <math>\x</math><math>\def\y{\y}\y</math><math>\x ^ c</math>"), (2, r"<math>\x</math>"), (3, None), (4, "none"),
    ]
    pages = wiki.with_formulas(spark.createDataFrame(rows, "page_id long, text string"))
    got = {r.page_id: r.mathes for r in pages.collect()}
    assert got == {1: [r"\x", "", "a + b", r"\def\y{\y}\y", "a + b^ c"], 2: [r"\x"], 3: [], 4: []}


@pytest.mark.parametrize("source", [
    r"\begin{array}[t]{cc}a&b\\ \hline c&d\end{array}", r"\left( a \middle| b \right)", r"\phantom{x}", r"\boxed{a}", r"\overleftarrow{AB}", r"\dddot{x}", r"a \tag{1}", r"\genfrac{(}{)}{0pt}{}{n}{k}",
    r"\bigsqcup_i A_i", r"\biguplus", r"\bigodot", r"\varGamma", r"\oiint_S", r"\begin{alignat}{2}a&=b\end{alignat}", r"\left\uparrow a \right\downarrow", r"\lgroup a \rgroup",
    r"\buildrel \text{def} \over =", r"\rightharpoondown", r"\R", r"\reals", r"\infin", r"\isin", r"\sdot", r"\part", r"\exist", r"a \and b \or c", r"\lang x \rang", r"\plusmn", r"\varkappa",
])
def test_more_commands_are_read(source):
    tree_of(source)


def test_old_names_are_their_commands():
    for old, new in latex.ALIASES.items():
        assert str(tree_of(rf"\{old} x")) == str(tree_of(rf"{new} x"))
    assert str(tree_of(r"\genfrac{}{}{0pt}{}{n}{k}")) == str(tree_of(r"\frac{n}{k}"))
    assert str(tree_of(r"\newcommand{\R}{Q}\R")) == str(tree_of("Q"))
