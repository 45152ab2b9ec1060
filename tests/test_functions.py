import pytest

from sigmalake.config import Settings
from sigmalake.functions import latex, mathml
from sigmalake.functions import mathtree as m
from sigmalake.functions.terms import query_clauses, terms_of, tree_of

CLEAN = Settings(reconstruct_expression=False, reorder_operands=False)
PRECEDENCE = Settings(reorder_operands=False)


def tree(source, settings=Settings()):
    s = str(tree_of(source, settings))
    assert s.startswith("<math>") and s.endswith("</math>")
    return s[6:-7]


def op(o, *x):
    return f"<mo o='{o}'>{''.join(x)}</mo>"


def mi(x):
    return f"<mi>{x}</mi>"


A, B, C, D, N, X, Y, Z = map(mi, "abcdnxyz")


@pytest.mark.parametrize("source, want", [(r"p \to q", "&ShortRightArrow;"), (r"p \rightarrow q", "&ShortRightArrow;"), (r"p \choose q", "choose")])
def test_markup(source, want):
    assert mathml.render(latex.parse(source)) == f"<math><mi>p</mi><mo>{want}</mo><mi>q</mi></math>"


@pytest.mark.parametrize("source, want", [
    ("a", A), ("ab", mi("ab")), ("a+b", A + op("+") + B), ("123", "<mn>123</mn>"), ("sin(x)", mi("sin") + f"<mfenced>{X}</mfenced>"),
    ("x ^ y + z", f"<msup>{X}{Y}</msup>" + op("+") + Z), ("x_n", f"<msub>{X}{N}</msub>"), (r"\sqrt{text}", f"<msqrt>{mi('text')}</msqrt>"),
    (r"\frac{a}{b}", f"<mfrac>{A}{B}</mfrac>"), ("a + b .", A + op("+") + B), (r"a + b \,", A + op("+") + B),
    (r"\sum_{i}^{n}", f"<munderover>{op('&Sum;')}{mi('i')}{N}</munderover>"), (r"\root_{i}^{j}", f"<msubsup><mrow></mrow>{mi('i')}{mi('j')}</msubsup>"),
])
def test_clean_up(source, want):
    assert tree(source, CLEAN) == want


@pytest.mark.parametrize("symbol, after, want", [
    ("+", False, 2), ("-", False, 2), ("+", True, 5), ("-", True, 5), ("*", True, 4), ("/", True, 4), ("<", True, 6), (">", True, 6),
    ("<=", True, 6), (">=", True, 6), ("&leq;", True, 6), ("&GreaterEqual;", True, 6), ("mod", True, 4), ("=", True, 100),
])
def test_priority(symbol, after, want):
    assert m.priority(symbol, after) == want


@pytest.mark.parametrize("source, symbol", [(r"a \leq b", "&leq;"), (r"a \geq b", "&GreaterEqual;"), (r"a \pmod b", "mod")])
def test_named_operators(source, symbol):
    assert tree(source) == op(symbol, A, B)


@pytest.mark.parametrize("source, want", [
    ("a + b", op("+", A, B)), ("a + b + c", op("+", op("+", A, B), C)), ("a * b + c", op("+", op("*", A, B), C)),
    ("a + b * c", op("+", A, op("*", B, C))), ("a * b + c * d", op("+", op("*", A, B), op("*", C, D))),
    ("a * ( b + c )", op("*", A, f"<mfenced><mrow>{op('+', B, C)}</mrow></mfenced>")), ("a + b / c", op("+", A, op("/", B, C))),
    ("a + b = c", op("=", op("+", A, B), C)), (r"\frac{1}{n} + b = c", op("=", op("+", f"<mfrac><mn>1</mn>{N}</mfrac>", B), C)),
    (r"\frac{1}{n} + 2*n = a+b", op("=", op("+", f"<mfrac><mn>1</mn>{N}</mfrac>", op("*", "<mn>2</mn>", N)), op("+", A, B))),
    (r"\cos x + y", op("cos", op("+", X, Y))), (r"\sum_i^n", f"<munderover>{mi('i')}{op('&Sum;', N)}</munderover>"),
    ("A^*", f"<msup>{op('*', mi('A'))}</msup>"), ("a = -b", A + op("=", op("-", B))), ("a + -b", op("+", A) + op("-", B)),
])
def test_precedence(source, want):
    assert tree(source, PRECEDENCE) == want


YZ = f"<mfenced><mrow>{op('+', Y, Z)}</mrow></mfenced>"
YZ_TIMES = f"<mfenced><mrow>{op('*', Y, Z)}</mrow></mfenced>"


@pytest.mark.parametrize("sources, want", [
    (("x + y", "y + x"), op("+", X, Y)), (("e ^ {x + y}", "e ^ {y + x}"), f"<msup>{mi('e')}<mrow>{op('+', X, Y)}</mrow></msup>"),
    (("(x + y) ^ z", "(y + x) ^ z"), f"<msup><mfenced><mrow>{op('+', X, Y)}</mrow></mfenced>{Z}</msup>"),
    (("(z + y) + x", "(y + z) + x", "x + (z + y)", "x + (y + z)"), op("+", YZ, X)),
    ((r"\cos{x + y}", r"\cos{y + x}"), op("cos", f"<mrow>{op('+', X, Y)}</mrow>")),
    ((r"\cos{x * y}", r"\cos{y * x}"), op("cos", f"<mrow>{op('*', X, Y)}</mrow>")),
    (("(z * y) + x", "(y * z) + x", "x + (z * y)", "x + (y * z)"), op("+", YZ_TIMES, X)),
])
def test_commutative_order(sources, want):
    assert {tree(s) for s in sources} == {want}


SUP = "<msup><mi></mi><mi></mi></msup>"


@pytest.mark.parametrize("inside, want", [
    ("<mi>a</mi>", []), ("<mi>a</mi><mo>+</mo><mi>b</mi>", [("<mo o='+'><mi></mi><mi></mi></mo>", 2, True), (op("+", A, B), 2, False)]),
    ("<mi>&shortparallel;</mi>", [(mi("&shortparallel;"), 2, False)]), ("<mi>a</mi><mi>b</mi>", [(mi("ab"), 2, False)]),
    ("<msup><mi>x</mi><mi>y</mi></msup>", [(SUP, 2, True), (f"<msup>{X}{Y}</msup>", 2, False)]),
    ("<msup><mi>x</mi><mi>y</mi></msup><mo>+</mo><mi>z</mi>", [
        ("<mo o='+'><mi></mi><msup></msup></mo>", 2, True), (op("+", Z, f"<msup>{X}{Y}</msup>"), 2, False), (SUP, 3, True), (f"<msup>{X}{Y}</msup>", 3, False)]),
    ("<mtext>foo</mtext>", [("<mtext>foo</mtext>", 2, False), ("foo", 3, False)]), ("<mrow></mrow>", [("", 2, False)]),
])
def test_terms(inside, want):
    assert terms_of(f"<math display='block'>\n {inside} </math>", mathml=True) == want


@pytest.mark.parametrize("bad", ["{a", "a}", r"\frac{a}", r"\nosuch x", "a^b^c", "a_b_c", r"\left( a", r"\begin{foo}\end{foo}", r"a & b"])
def test_unreadable_formulas_raise(bad):
    with pytest.raises(m.MathError):
        latex.parse(bad)


def test_more_of_latex():
    for source in [
        r"\sqrt{A^*A}=U|\Lambda|U^*", r"s_n(T) = \inf\big\{\, \|T-L\| : L\text{ is an operator of finite rank }<n \,\big\}.",
        r"\begin{pmatrix} a & b \\ c & d \end{pmatrix}", r"f(x) = \begin{cases} 1 & x > 0 \\ 0 & \mbox{else} \end{cases}", r"\left[ \frac{1}{2}, \infty \right)",
        r"\sqrt[3]{x}", r"\root n \of x", r"\int_0^1 f'(x)\,dx", r"\lim_{n \to \infty} a_n", r"\overline{x} \not= \hat y", r"x^12", r"\mathbf{R}^n", "[0, 1)", "% note\na",
    ]:
        assert tree_of(source)
    assert tree(r"x^12", CLEAN) == f"<msup>{X}<mn>1</mn></msup><mn>2</mn>"
    assert tree(r"\lim_{n} a", CLEAN) == f"<munder>{op('lim')}{N}</munder>{A}"


def test_switches_and_clauses():
    off = Settings(adjust_tree=False, reconstruct_expression=False, reorder_operands=False)
    assert terms_of("a+b", off)[0].term == "<mi>a</mi><mo>+</mo><mi>b</mi>" or terms_of("a+b", off)[0].generalization
    assert all(not t.generalization for t in terms_of("a+b", Settings(generalise=False)))
    assert query_clauses([(1, "a"), (2, "{"), (3, "b + a")]) == [(3, 0, "<mo o='+'><mi></mi><mi></mi></mo>", 2, True), (3, 1, op("+", A, B), 2, False)]


def test_order_is_by_utf16():
    assert m.order_key(m.leaf("mi", "\U0001d400")) < m.order_key(m.leaf("mi", "Ａ"))


@pytest.mark.parametrize("empty", ["", " ", "\n", r"\,", "{}"])
def test_empty_formulas_have_no_terms(empty):
    assert [t for t in terms_of(empty) if t.level == 1] == [] and all(t.term == "" for t in terms_of(empty))


@pytest.mark.parametrize("latex, tree", [
    (r"{a \over b}", "<mfrac><mi>a</mi><mi>b</mi></mfrac>"), (r"a \leqslant b", "<mo o='&les;'><mi>a</mi><mi>b</mi></mo>"),
    (r"\mathop{x}", "<mi>x</mi>"), (r"\color{red} x", "<mi>x</mi>"), (r"\left\lVert x \right\rVert", "<mfenced><mi>x</mi></mfenced>"),
    (r"\xrightarrow{f}", "<mover><mo>&rightarrow;</mo><mi>f</mi></mover>"),
])
def test_more_commands(latex, tree):
    got = str(tree_of(latex))
    assert tree in got or latex.startswith(r"\xright") and "&rightarrow;" in got


@pytest.mark.parametrize("name", "dagger Longleftrightarrow subsetneq lbrace nleq triangleq rVert gets nexists therefore".split())
def test_known_symbols(name):
    tree_of(rf"a \{name} b")


def test_lines_and_sides():
    tree_of(r"\sum_{\substack{i < n \\ j}} x")
    tree_of(r"\sideset{a}{b}\prod x")
    tree_of(r"a \xrightarrow[x]{y} b")


def test_results_of_equal_formulas_are_made_once(monkeypatch):
    """A batch's work in Python follows its different formulas, not its rows; nulls, empty and unreadable ones keep their places."""
    import pyarrow as pa

    from sigmalake.functions import terms

    made, plain = [], terms.folded
    monkeypatch.setattr(terms, "folded", lambda found: made.append(1) or plain(found))
    column = pa.array(["a + b", None, r"\frac{a}{b}", "", "{", "a + b"] * 1000)
    got = terms.results(column).to_pylist()
    assert len(made) == 4 and len(got) == 6000
    for f, r in zip(column.to_pylist(), got):
        found, tree, bad = terms.analysed(f, terms.DEFAULT, False) if f else ([], None, False)
        assert r == {"terms": [t._asdict() for t in found], "folded": plain(found), "tree": tree, "is_error": bad}
    assert terms.results(pa.array([], pa.string())).to_pylist() == []
    few = terms.results(column, counted=True).to_pylist()
    assert few == [{"folded": r["folded"], "n_terms": len(r["terms"]), "is_error": r["is_error"]} for r in got]
