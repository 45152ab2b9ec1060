"""The formula engine's queries over a templated corpus, and the same in SQL.

Pages are customers and suppliers, formulas are all orders: letters from the
keys, one of eight templates each. Spark reads the LaTeX of the templates; SQL
writes down the terms that should come out, so the readers and rewrites are
checked by it too. Suppliers, with negative ids, are pages without formulas.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import search_json
from .config import Settings
from .functions import hooks, scoring
from .functions.terms import analyse, explode_terms
from .operators import index as index_tables
from .operators.scratch import new_path, written
from .operators.segments import Segments, ingest
from .plans import evaluate, explain, search, topk
from .sources import labels as label_table
from .sources import wiki

#: The eight templates; @ and ~ are letters.
TEMPLATES = ("@ + ~", "~ + @", r"\frac{@}{~}", "@ ^ ~", "@ ^ ~ + z", "@ * ~ + c", "@~", "@")
DIGITS = 6


# --- the corpus -----------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("page_id"), F.col("c_name").alias("title"))
    return c.union(table(spark, sf, "supplier").select(-1 - F.col("s_suppkey"), "s_name"))


def formulas(spark: SparkSession, sf: str, templates=TEMPLATES) -> DataFrame:
    o = table(spark, sf, "orders")
    a, b = F.char(F.lit(97) + F.col("o_orderkey") % 7), F.char(F.lit(97) + F.col("o_custkey") % 5)
    choice = F.lit(None).cast("string")
    for k, t in reversed(list(enumerate(templates))):
        pieces = [p for p in re.split("([@~])", t) if p]
        piece = F.concat(*[{"@": a, "~": b}.get(p, F.lit(p)) for p in pieces])
        choice = F.when(F.col("o_orderkey") % 8 == k, piece).otherwise(choice)
    return o.select(F.col("o_orderkey").alias("formula_id"), F.col("o_custkey").alias("page_id"), choice.alias("latex"), F.col("o_orderkey").alias("key"))


def corpus(spark: SparkSession, sf: str) -> index_tables.Index:
    """The index, its analysed formulas written once."""
    f = formulas(spark, sf)
    known = index_tables.analysed(f).select(*index_tables.KNOWN)
    return index_tables.of_known(pages(spark, sf), f, written(known, "known"))


#: SQL: letters, expected terms, postings of both indexes.
L = "chr((97 + o_orderkey % 7)::int) a, chr((97 + o_custkey % 5)::int) b"
BASE = f"""
pages as (select c_custkey page_id, c_name title from customer union all select -1 - s_suppkey, s_name from supplier),
f as (select o_orderkey formula_id, o_custkey page_id, o_orderkey % 8 t, {L} from orders),
i as (select *, '<mi>' || a || '</mi>' ma, '<mi>' || b || '</mi>' mb from f),
terms as (
  select formula_id, page_id, t, unnest(l) x, generate_subscripts(l, 1) - 1 ord from (select *, case t
    when 0 then [g('<mo o=''+''><mi></mi><mi></mi></mo>', 2, true), g('<mo o=''+''>' || least(ma, mb) || greatest(ma, mb) || '</mo>', 2, false)]
    when 1 then [g('<mo o=''+''><mi></mi><mi></mi></mo>', 2, true), g('<mo o=''+''>' || least(ma, mb) || greatest(ma, mb) || '</mo>', 2, false)]
    when 2 then [g('<mfrac><mi></mi><mi></mi></mfrac>', 2, true), g('<mfrac>' || ma || mb || '</mfrac>', 2, false)]
    when 3 then [g('<msup><mi></mi><mi></mi></msup>', 2, true), g('<msup>' || ma || mb || '</msup>', 2, false)]
    when 4 then [g('<mo o=''+''><mi></mi><msup></msup></mo>', 2, true), g('<mo o=''+''><mi>z</mi><msup>' || ma || mb || '</msup></mo>', 2, false),
                 g('<msup><mi></mi><mi></mi></msup>', 3, true), g('<msup>' || ma || mb || '</msup>', 3, false)]
    when 5 then [g('<mo o=''+''><mi></mi><mo o=''*''></mo></mo>', 2, true),
                 g('<mo o=''+''><mi>c</mi><mo o=''*''>' || least(ma, mb) || greatest(ma, mb) || '</mo></mo>', 2, false),
                 g('<mo o=''*''><mi></mi><mi></mi></mo>', 3, true), g('<mo o=''*''>' || least(ma, mb) || greatest(ma, mb) || '</mo>', 3, false)]
    when 6 then [g('<mi>' || a || b || '</mi>', 2, false)]
    else [] end l from i)),
e as (select formula_id, page_id, t, ord, x.term, x.level, x.gen from terms),
post_formula as (select formula_id doc_id, page_id, term, array_agg(distinct level order by level) levels from e group by all),
post_page as (select page_id doc_id, page_id, term, array_agg(distinct level order by level) levels from e group by page_id, term),
len_formula as (select f.formula_id doc_id, count(e.term) len from f left join e using (formula_id) group by f.formula_id),
len_page as (select p.page_id doc_id, count(e.term) len from pages p left join e using (page_id) group by p.page_id),
docs_formula as (select doc_id, len, {{norm}} norm from len_formula),
docs_page as (select doc_id, len, {{norm}} norm from len_page),
df_formula as (select term, count(*) df from post_formula group by term),
df_page as (select term, count(*) df from post_page group by term)
"""
NORM = "case when len > 0 then floor(pow(2, ceil(log2(len)) + 2) / len) / pow(2, ceil(log2(len)) + 2) else 0.0::double end"


def _base() -> str:
    """The corpus in SQL; g(term, level, general) stands for a struct."""
    s = BASE.replace("{norm}", NORM)
    out, at = [], 0
    while (k := s.find("g('", at)) >= 0:
        depth, j, quoted = 0, k + 1, False
        while True:
            if s[j] == "'":
                quoted = not quoted
            elif not quoted:
                depth += (s[j] == "(") - (s[j] == ")")
                if depth == 0:
                    break
            j += 1
        term, level, general = s[k + 2 : j].rsplit(", ", 2)
        out.append(s[at:k] + f"struct_pack(term := {term}, level := {level}, gen := {general})")
        at = j + 1
    return "with " + "".join(out) + s[at:]


#: Queries by id: two known terms, a sum, a query with an unknown term, one without terms.
QUERIES = ((1, "a + b"), (2, "a ^ b + z"), (3, r"\frac{c}{d}"), (4, "q + r"), (5, "a"), (6, "c * d + c"))


def _clauses_sql(queries=QUERIES) -> str:
    """The clauses of queries as VALUES."""
    rows = []
    for query_id, latex in queries:
        for n, t in enumerate(_expected(latex)):
            term = t[0].replace("'", "''")
            rows.append(f"({query_id}::bigint, {n}, '{term}', {t[1]}, {str(t[2]).lower()})")
    values = ", ".join(rows) or "(0, 0, '', 0, false)"
    where = "" if rows else " where false"
    return f"q as (select *, case when gen then 0.5 else 1.0 end::double boost from (values {values}) v(query_id, clause, term, level, gen){where})"


def _expected(latex: str) -> list[tuple]:
    """The terms of the fixed queries, written out by hand."""
    sup = [("<msup><mi></mi><mi></mi></msup>", 3, True), ("<msup><mi>a</mi><mi>b</mi></msup>", 3, False)]
    return {
        "a + b": [("<mo o='+'><mi></mi><mi></mi></mo>", 2, True), ("<mo o='+'><mi>a</mi><mi>b</mi></mo>", 2, False)],
        "a ^ b + z": [("<mo o='+'><mi></mi><msup></msup></mo>", 2, True), ("<mo o='+'><mi>z</mi><msup><mi>a</mi><mi>b</mi></msup></mo>", 2, False), *sup],
        r"\frac{c}{d}": [("<mfrac><mi></mi><mi></mi></mfrac>", 2, True), ("<mfrac><mi>c</mi><mi>d</mi></mfrac>", 2, False)],
        "q + r": [("<mo o='+'><mi></mi><mi></mi></mo>", 2, True), ("<mo o='+'><mi>q</mi><mi>r</mi></mo>", 2, False)],
        "a": [],
        "c * d + c": [
            ("<mo o='+'><mi></mi><mo o='*'></mo></mo>", 2, True), ("<mo o='+'><mi>c</mi><mo o='*'><mi>c</mi><mi>d</mi></mo></mo>", 2, False),
            ("<mo o='*'><mi></mi><mi></mi></mo>", 3, True), ("<mo o='*'><mi>c</mi><mi>d</mi></mo>", 3, False),
        ],
    }[latex]


BEST = "1.0::double / (1 + list_min(list_transform(p.levels, lambda x: abs(x - n.level))))"


def _search_sql(queries=QUERIES, proximity=BEST) -> str:
    """The corpus, the clauses, and the scores of both indexes and of pages."""
    parts = [_base(), _clauses_sql(queries)]
    for kind in ("formula", "page"):
        parts.append(f"""
w_{kind} as (select q.*, coalesce(df, 0) df, 1 + ln((select count(*) from docs_{kind})::double / (coalesce(df, 0) + 1)) idf from q left join df_{kind} using (term)),
n_{kind} as (select *, count(*) over (partition by query_id) n, 1 / sqrt(sum(pow(idf * boost, 2)) over (partition by query_id)) qn from w_{kind}),
m_{kind} as (select n.*, p.doc_id, p.page_id, {proximity} prox
  from n_{kind} n join post_{kind} p using (term)),
s_{kind} as (select query_id, m.doc_id, page_id, count(*) matched, count(*)::double / any_value(n) * any_value(qn) * any_value(norm) * sum(idf * idf * boost * prox) score
  from m_{kind} m join docs_{kind} d on d.doc_id = m.doc_id group by query_id, m.doc_id, page_id)""")
    parts.append("""
best as (select query_id, page_id, doc_id formula_id, score formula_score from s_formula
  qualify row_number() over (partition by query_id, page_id order by round(score, 12) desc, doc_id) = 1)""")
    parts.append("""
r as (select b.query_id, b.page_id, formula_id, formula_score, p.score page_score, 0.7 * formula_score + 0.3 * p.score score
  from best b join s_page p on p.query_id = b.query_id and p.page_id = b.page_id)""")
    parts.append("ranked as (select *, row_number() over (partition by query_id order by round(score, 10) desc, page_id)::int rank from r)")
    return ",\n".join(parts)


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, {DIGITS}) {c}" for c in columns)


# --- queries --------------------------------------------------------------

QUERY: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERY[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


WIKI = "'text ' || string_agg('<math>' || latex || '</math>', ' and ' order by formula_id) || ' <math display=\"x\">no</math> end'"
LATEX = """case t when 0 then a || ' + ' || b when 1 then b || ' + ' || a when 2 then '\\frac{' || a || '}{' || b || '}' when 3 then a || ' ^ ' || b
  when 4 then a || ' ^ ' || b || ' + z' when 5 then a || ' * ' || b || ' + c' when 6 then a || b else a end"""


def _wiki_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages (page_id, title, text) with their formulas in wiki text."""
    marked = F.concat(F.lit("<math>"), "latex", F.lit("</math>"))
    row = F.sort_array(F.collect_list(F.struct("formula_id", marked.alias("m"))))
    f = formulas(spark, sf).groupBy("page_id").agg(F.array_join(F.transform(row, lambda x: x["m"]), " and ").alias("body"))
    text = F.concat(F.lit("text "), F.coalesce("body", F.lit("none")), F.lit(' <math display="x">no</math> end'))
    return pages(spark, sf).join(f, "page_id", "left").select("page_id", "title", text.alias("text"))


@query("extract_math", _base() + f", l as (select *, {LATEX} latex from i) select page_id, (row_number() over (partition by page_id order by formula_id) - 1)::int pos, latex from l")
def extract_math(spark, sf):
    p = wiki.with_formulas(_wiki_pages(spark, sf))
    return p.select("page_id", F.posexplode("mathes").alias("pos", "latex"))


@query("extract_html_paragraphs", """select page_id, (generate_subscripts(m, 1) - 1)::int pos, unnest(m) body
  from (select page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) m from pages)""")
def extract_html_paragraphs(spark, sf):
    each = wiki.extract(F.col("html"), r"(?s)<p>(.*?)</p>")
    return table(spark, sf, "pages").select("page_id", F.posexplode(each).alias("pos", "body"))


def _counted(spark, sf):
    n = formulas(spark, sf).groupBy("page_id").agg(F.count("*").alias("n_formulas"))
    return pages(spark, sf).join(n, "page_id", "left").select("page_id", F.coalesce("n_formulas", F.lit(0)).alias("n_formulas"))


@query("formula_cap", _base() + """, n as (select p.page_id, count(f.formula_id) n_formulas from pages p left join f using (page_id) group by p.page_id)
  select page_id, n_formulas from n qualify coalesce(sum(n_formulas) over (order by page_id rows between unbounded preceding and 1 preceding), 0) < 5000""")
def formula_cap(spark, sf):
    return wiki.capped(_counted(spark, sf), 5000)


@query("assign_ids", _base() + " select row_number() over (order by page_id, formula_id)::bigint formula_id, page_id, formula_id as key from f")
def assign_ids(spark, sf):
    f = formulas(spark, sf).select("page_id", "key")
    return wiki.numbered(f, ["page_id", "key"], "formula_id").select("formula_id", "page_id", "key")


def _terms_under(root: str):
    """The terms of all formulas whose tree starts with ``root``."""

    def run(spark, sf):
        found = explode_terms(formulas(spark, sf)).where(F.startswith("term", F.lit(root)))
        return found.select("formula_id", "term", "level", "generalization")

    return run


for _name, _root in (("all", "<"), ("plus", "<mo o='+'>"), ("frac", "<mfrac>"), ("sup", "<msup>"), ("mul", "<mo o='*'>"), ("merge_mi", "<mi>")):
    _quoted = _root.replace("'", "''")
    query(f"terms_{_name}", _base() + f" select formula_id, term, level, gen generalization from e where starts_with(term, '{_quoted}')")(_terms_under(_root))


@query("terms_no_gen", _base() + " select formula_id, term, level from e where not gen")
def terms_no_gen(spark, sf):
    return explode_terms(formulas(spark, sf), settings=Settings(generalise=False)).select("formula_id", "term", "level")


def _exact_sql(templates: dict) -> str:
    """Exact terms of every formula by template, written with its letters' tags ``ma`` and ``mb``."""
    cases = " ".join(f"when {t} then [{', '.join(terms)}]" for t, terms in templates.items())
    return _base() + f" select formula_id, unnest(case t {cases} else [] end) term from i"


_SUP, _FRAC, _MUL = ("'{}' || {{}} || '{}'".format(f"<{x}>", f"</{x.split()[0]}>") for x in ("msup", "mfrac", "mo o=''*''"))
_SUM = "'<mo o=''+''>' || {} || '</mo>'"


@query("terms_no_reorder", _exact_sql({
    0: [_SUM.format("ma || mb")], 1: [_SUM.format("mb || ma")], 2: [_FRAC.format("ma || mb")], 3: [_SUP.format("ma || mb")],
    4: [_SUM.format(_SUP.format("ma || mb") + " || '<mi>z</mi>'"), _SUP.format("ma || mb")],
    5: [_SUM.format(_MUL.format("ma || mb") + " || '<mi>c</mi>'"), _MUL.format("ma || mb")], 6: ["'<mi>' || a || b || '</mi>'"],
}))
def terms_no_reorder(spark, sf):
    found = explode_terms(formulas(spark, sf), settings=Settings(reorder_operands=False))
    return found.where("not generalization").select("formula_id", "term")


_PLUS, _TIMES = "'<mo>+</mo>'", "'<mo>*</mo>'"


@query("terms_no_adjust", _exact_sql({
    0: [f"ma || {_PLUS} || mb", "ma", _PLUS, "mb"], 1: [f"mb || {_PLUS} || ma", "mb", _PLUS, "ma"],
    2: [_FRAC.format("ma || mb"), "ma", "mb"], 3: [_SUP.format("ma || mb"), "ma", "mb"],
    4: [_SUP.format("ma || mb") + f" || {_PLUS} || '<mi>z</mi>'", _SUP.format("ma || mb"), "ma", "mb", _PLUS, "'<mi>z</mi>'"],
    5: [f"ma || {_TIMES} || mb || {_PLUS} || '<mi>c</mi>'", "ma", _TIMES, "mb", _PLUS, "'<mi>c</mi>'"],
    6: ["ma || mb", "ma", "mb"], 7: ["ma"],
}))
def terms_no_adjust(spark, sf):
    off = Settings(adjust_tree=False, reconstruct_expression=False, reorder_operands=False)
    found = explode_terms(formulas(spark, sf), settings=off)
    return found.where("not generalization").select("formula_id", "term")


#: Templates over letters @ (a to g) and ~ (p to t), so that their order is known, and their trees.
GOLDENS = (
    ("@~", "<math><mi>@~</mi></math>"), ("sin(@)", "<math><mi>sin</mi><mfenced><mi>@</mi></mfenced></math>"),
    ("~ + @ .", "<math><mo o='+'><mi>@</mi><mi>~</mi></mo></math>"),
    ("~ + @ + z", "<math><mo o='+'><mi>z</mi><mo o='+'><mi>@</mi><mi>~</mi></mo></mo></math>"),
    ("@ + z * ~", "<math><mo o='+'><mi>@</mi><mo o='*'><mi>~</mi><mi>z</mi></mo></mo></math>"),
    ("@ * ( ~ + z )", "<math><mo o='*'><mfenced><mrow><mo o='+'><mi>~</mi><mi>z</mi></mo></mrow></mfenced><mi>@</mi></mo></math>"),
    (r"\frac{1}{@} + ~ = z", "<math><mo o='='><mo o='+'><mfrac><mn>1</mn><mi>@</mi></mfrac><mi>~</mi></mo><mi>z</mi></mo></math>"),
    ("e ^ {~ + @}", "<math><msup><mi>e</mi><mrow><mo o='+'><mi>@</mi><mi>~</mi></mo></mrow></msup></math>"),
    (r"\cos{~ * @}", "<math><mo o='cos'><mrow><mo o='*'><mi>@</mi><mi>~</mi></mo></mrow></mo></math>"),
    (r"\sum_@^~", "<math><munderover><mi>@</mi><mo o='&Sum;'><mi>~</mi></mo></munderover></math>"),
    ("@ + -~", "<math><mo o='+'><mi>@</mi></mo><mo o='-'><mi>~</mi></mo></math>"),
    (r"@ \to ~", "<math><mo o='&ShortRightArrow;'><mi>@</mi><mi>~</mi></mo></math>"),
    (r"\alpha @ \le \frac{~}{2}", "<math><mo o='&leq;'><mi>&alpha;@</mi><mfrac><mi>~</mi><mn>2</mn></mfrac></mo></math>"),
    (r"\begin{matrix}@&~\end{matrix}", "<math><mtable><mtr><mtd><mi>@</mi></mtd><mtd><mi>~</mi></mtd></mtr></mtable></math>"),
)

#: The same for MathML: attributes, fences, character references, entities, comments, CDATA, runs of operators, text; with its terms.
MARKUP = (
    ('<math xmlns="m" display="block"><msup><mi>@</mi><mi mathvariant="italic">~</mi></msup><mo stretchy="false">+</mo><mi>z</mi></math>', (
        ("<mo o='+'><mi></mi><msup></msup></mo>", 2, True), ("<mo o='+'><mi>z</mi><msup><mi>@</mi><mi>~</mi></msup></mo>", 2, False),
        ("<msup><mi></mi><mi></mi></msup>", 3, True), ("<msup><mi>@</mi><mi>~</mi></msup>", 3, False))),
    ('<math><mfenced open="(" close="]"><mi>@</mi><mo>&#43;</mo><mi>~</mi></mfenced></math>', (
        ("<mfenced><mo o='+'></mo></mfenced>", 2, True), ("<mfenced><mo o='+'><mi>@</mi><mi>~</mi></mo></mfenced>", 2, False),
        ("<mo o='+'><mi></mi><mi></mi></mo>", 3, True), ("<mo o='+'><mi>@</mi><mi>~</mi></mo>", 3, False))),
    ("<math><mi>&alpha;</mi><mo>&le;</mo><mi>@</mi></math>", (
        ("<mo o='&le;'><mi></mi><mi></mi></mo>", 2, True), ("<mo o='&le;'><mi>&alpha;</mi><mi>@</mi></mo>", 2, False), ("<mi>&alpha;</mi>", 3, False))),
    ("<math><mi>@</mi><mo>=</mo><mo>-</mo><mi>~</mi></math>", (
        ("<mi></mi><mo o='='></mo>", 1, True), ("<mi>@</mi><mo o='='><mo o='-'><mi>~</mi></mo></mo>", 1, False),
        ("<mo o='='><mo o='-'></mo></mo>", 2, True), ("<mo o='='><mo o='-'><mi>~</mi></mo></mo>", 2, False),
        ("<mo o='-'><mi></mi></mo>", 3, True), ("<mo o='-'><mi>~</mi></mo>", 3, False))),
    ("<math><!-- @ --><mi>~</mi><mo><![CDATA[*]]></mo> <mi> @ </mi></math>", (
        ("<mo o='*'><mi></mi><mi></mi></mo>", 2, True), ("<mo o='*'><mi>@</mi><mi>~</mi></mo>", 2, False))),
    ("<math><mtext>if  </mtext><mi>@</mi></math>", (
        ("<mtext></mtext><mi></mi>", 1, True), ("<mtext>if</mtext><mi>@</mi>", 1, False), ("<mtext>if</mtext>", 2, False), ("if", 3, False))),
)


def _quoted(s: str) -> str:
    """A text in SQL."""
    return "'" + s.replace("'", "''") + "'"


def _lettered_sql(column: str) -> str:
    """SQL of a template's text with its letters set in."""
    return f"replace(replace({column}, '@', chr((97 + o_orderkey % 7)::int)), '~', chr((112 + o_custkey % 5)::int))"


def _lettered(spark, sf, templates) -> DataFrame:
    """(formula_id, latex): every order with one of the templates."""
    o, n = table(spark, sf, "orders"), len(templates)
    text = F.element_at(F.array(*[F.lit(t) for t in templates]), (F.col("o_orderkey") % n + 1).cast("int"))
    for mark, start, key, m in (("@", 97, "o_orderkey", 7), ("~", 112, "o_custkey", 5)):
        text = F.replace(text, F.lit(mark), F.char(F.lit(start) + F.col(key) % m))
    return o.select(F.col("o_orderkey").alias("formula_id"), text.alias("latex"))


@query("tree_goldens", f"""select o_orderkey formula_id, {_lettered_sql('latex')} latex, {_lettered_sql('tree')} tree
  from orders join (values {", ".join(f"({k}, {_quoted(a)}, {_quoted(b)})" for k, (a, b) in enumerate(GOLDENS))}) v(k, latex, tree) on o_orderkey % {len(GOLDENS)} = k""")
def tree_goldens(spark, sf):
    f = _lettered(spark, sf, [a for a, _ in GOLDENS])
    return f.select("formula_id", "latex", analyse(F.col("latex"))["tree"].alias("tree"))


@query("mathml_input", f"""select o_orderkey formula_id, ord, {_lettered_sql('term')} term, level, generalization from orders join (values
  {", ".join(f"({k}, {n}, {_quoted(t)}, {level}, {str(general).lower()})" for k, (_, terms) in enumerate(MARKUP) for n, (t, level, general) in enumerate(terms))}
  ) v(k, ord, term, level, generalization) on o_orderkey % {len(MARKUP)} = k""")
def mathml_input(spark, sf):
    return explode_terms(_lettered(spark, sf, [a for a, _ in MARKUP]), mathml=True).drop("latex")


#: The templates written with macros of the page: nested, with a default, by \\def, by \\let, and a name that stays plain.
DEFINED = (
    r"\newcommand{\pair}[2]{#1 + #2}\def\swap#1#2{\pair{#2}{#1}}\def\ratio(#1:#2){\frac{#1}{#2}}"
    r"\newcommand{\up}[2][b]{#2 ^ #1}\let\plus\pair\newcommand\both[2]{#1#2}\providecommand{\both}[1]{#1}\newcommand{\one}[1]{\only{#1}}\renewcommand{\one}[1]{#1}"
)
USES = (r"\pair{@}{~}", r"\swap @ ~", r"\ratio(@:~)", r"\up[~]{@}", r"\pair{\up[~]@}z", r"\plus{@ * ~}{c}", r"\both @~", r"\one{@}")


@query("terms_macros", _base() + " select formula_id, term, level, gen generalization from e")
def terms_macros(spark, sf):
    """Terms of the formulas of pages whose first formula defines what the others are written with."""
    f = formulas(spark, sf, USES)
    rows = f.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("formula_id", "latex"))).alias("rows"))
    text = F.concat(F.lit(f"<math>{DEFINED}</math>"), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("<math>"), r["latex"], F.lit("</math>"))), " "))
    page = wiki.with_formulas(rows.select("page_id", "rows", text.alias("text")))
    own = page.select(F.explode(F.arrays_zip(F.col("rows.formula_id").alias("id"), F.slice("mathes", F.lit(2), F.size("rows")).alias("latex"))).alias("r"))
    found = explode_terms(own.select(F.col("r.id").alias("formula_id"), F.col("r.latex").alias("latex")))
    return found.select("formula_id", "term", "level", "generalization")


@query("doc_length", _base() + " select 'formula' kind, doc_id, len from docs_formula union all select 'page', doc_id, len from docs_page")
def doc_length(spark, sf):
    i = corpus(spark, sf)
    return i.docs["formula"].select(F.lit("formula").alias("kind"), "doc_id", "len").unionByName(i.docs["page"].select(F.lit("page").alias("kind"), "doc_id", "len"))


@query("doc_norm", _base() + " select 'formula' kind, doc_id, norm from docs_formula union all select 'page', doc_id, norm from docs_page")
def doc_norm(spark, sf):
    i = corpus(spark, sf)
    return i.docs["formula"].select(F.lit("formula").alias("kind"), "doc_id", "norm").unionByName(i.docs["page"].select(F.lit("page").alias("kind"), "doc_id", "norm"))


@query("term_df_formula", _base() + " select term, df from df_formula")
def term_df_formula(spark, sf):
    return corpus(spark, sf).term_stats["formula"]


@query("term_df_page", _base() + " select term, df from df_page")
def term_df_page(spark, sf):
    return corpus(spark, sf).term_stats["page"]


@query("term_idf", _base() + f" select term, round(1 + ln((select count(*) from docs_formula)::double / (df + 1)), {DIGITS}) idf from df_formula")
def term_idf(spark, sf):
    i = corpus(spark, sf)
    n = i.docs["formula"].agg(F.count("*").alias("n"))
    return i.term_stats["formula"].crossJoin(F.broadcast(n)).select("term", F.round(scoring.idf(F.col("n"), F.col("df")), DIGITS).alias("idf"))


def _postings(kind: str):
    def run(spark, sf):
        return corpus(spark, sf).postings[kind].select("doc_id", "term", F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"))

    return run


for _kind in ("formula", "page"):
    query(f"postings_{_kind}", _base() + f" select doc_id, term, array_to_string(levels, ',') levels from post_{_kind}")(_postings(_kind))


def _asked(spark, sf, kind, queries):
    index, q = search.prepared(corpus(spark, sf), queries)
    return index, kind, q


@query("payload_proximity", _search_sql() + f" select query_id, clause, doc_id, {_r('prox')} from m_formula")
def payload_proximity(spark, sf):
    m = search.matches(*_asked(spark, sf, "formula", QUERIES))
    return m.select("query_id", "clause", "doc_id", F.round("proximity", DIGITS).alias("prox"))


@query("query_norm", _search_sql() + f" select distinct query_id, round(qn, {DIGITS}) qn from n_formula")
def query_norm(spark, sf):
    w = search.weighted(corpus(spark, sf), "formula", search.clauses(spark, QUERIES))  # as many queries are weighted: by joins
    return w.groupBy("query_id").agg(F.round(F.first("query_norm"), DIGITS).alias("qn"))


@query("coord", _search_sql() + f" select query_id, doc_id, round(count(*)::double / any_value(n), {DIGITS}) coord from m_formula group by query_id, doc_id")
def coord(spark, sf):
    m = search.matches(*_asked(spark, sf, "formula", QUERIES))
    return m.groupBy("query_id", "doc_id").agg(F.round(F.count("*") / F.first("n_clauses"), DIGITS).alias("coord"))


def _documents(kind: str):
    def run(spark, sf):
        s = search.search_documents(*_asked(spark, sf, kind, QUERIES[:1]))
        return _round(s.select("doc_id", "page_id", "matched", "score"), "score")

    return run


for _kind in ("formula", "page"):
    query(f"search_{_kind}", _search_sql(QUERIES[:1]) + f" select doc_id, page_id, matched, {_r('score')} from s_{_kind}")(_documents(_kind))


@query("best_formula_per_page", _search_sql() + f" select query_id, page_id, formula_id, {_r('formula_score')} from best")
def best_formula_per_page(spark, sf):
    return _round(search.best_formulas(*search.prepared(corpus(spark, sf), QUERIES)), "formula_score")


def _found(spark, sf, queries=QUERIES[:1]):
    return search.search(*search.prepared(corpus(spark, sf), queries))


SCORES = ("formula_score", "page_score", "score")


@query("search_merged", _search_sql(QUERIES[:1]) + f" select page_id, formula_id, {_r(*SCORES)} from r")
def search_merged(spark, sf):
    return _round(_found(spark, sf), *SCORES).drop("query_id")


def _page(page: int, size: int = 10):
    def run(spark, sf):
        return _round(search.result_page(_found(spark, sf), page, size), *SCORES).drop("query_id")

    return run


for _name, _number in (("search_page1", 1), ("search_page2", 2), ("search_past_end", 1_000_000)):
    query(_name, _search_sql(QUERIES[:1]) + f" select page_id, formula_id, {_r(*SCORES)}, rank from ranked where rank > {10 * (_number - 1)} and rank <= {10 * _number}")(_page(_number))


@query("search_unknown_term", _search_sql(QUERIES[3:4]) + f" select page_id, formula_id, {_r(*SCORES)} from r")
def search_unknown_term(spark, sf):
    return _round(_found(spark, sf, QUERIES[3:4]), *SCORES).drop("query_id")


@query("search_zero_token_query", _search_sql(QUERIES[4:5]) + f" select page_id, formula_id, {_r(*SCORES)} from r")
def search_zero_token_query(spark, sf):
    return _round(_found(spark, sf, QUERIES[4:5]), *SCORES).drop("query_id")


@query("search_total_hits", _search_sql() + " select query_id, count(*) total from r group by query_id")
def search_total_hits(spark, sf):
    return search.total_hits(_found(spark, sf, QUERIES))


@query("search_batch", _search_sql() + f" select query_id, page_id, formula_id, {_r(*SCORES)}, rank from ranked where rank <= 10")
def search_batch(spark, sf):
    return _round(search.result_page(_found(spark, sf, QUERIES), 1, 10), *SCORES)


def _top(spark, sf, query, k=10):
    """The best ``k`` of a written index, by thresholds."""
    path = new_path(spark, "index")
    index_tables.write(corpus(spark, sf), path)
    index, q = search.prepared(index_tables.read(spark, path), [query])
    return search.result_page(topk.top_k(index, q, k), 1, k)


for _name, _query in (("search_top_k", QUERIES[0]), ("search_top_k_deep", QUERIES[1]), ("search_top_k_product", QUERIES[5])):
    query(_name, _search_sql((_query,)) + f" select page_id, formula_id, {_r(*SCORES)}, rank from ranked where rank <= 10")(
        lambda spark, sf, own=_query: _round(_top(spark, sf, own), *SCORES).drop("query_id")
    )


@query("search_top_k_hits", _search_sql() + " select query_id, count(*) total from r group by query_id")
def search_top_k_hits(spark, sf):
    """Numbers of pages that match, without scoring them."""
    index, rows = corpus(spark, sf), []
    for own in QUERIES:
        cut, q = search.prepared(index, [own])
        rows.append((own[0], topk.total_hits(cut, q)))
    return spark.createDataFrame(rows, "query_id long, total long").where("total > 0")


URL = "'http://en.wikipedia.org/wiki/' || replace(replace(replace(title, ' ', '_'), '%', '%25'), '#', '%23')"


@query("doc_url", _base() + f" select page_id, {URL} doc_url from pages")
def doc_url(spark, sf):
    return pages(spark, sf).select("page_id", scoring.wiki_url(F.col("title")).alias("doc_url"))


@query("explain_terms", _base() + f""", l as (select *, {LATEX} latex from i), asked as (select min(formula_id) formula_id from l group by latex)
  select formula_id query_id, ord clause, term, level, gen generalization from e join asked using (formula_id)""")
def explain_terms(spark, sf):
    """The clauses of all different formulas, asked as queries."""
    asked = formulas(spark, sf).groupBy(F.col("latex").alias("query")).agg(F.min("formula_id").alias("query_id"))
    return explain.explain_terms(search.clauses_of(asked))


@query("explain_scores", _search_sql(QUERIES[1:2]) + f"""
  , c as (select *, count(*) over (partition by m.doc_id) matched from m_page m)
  select c.doc_id, clause, term, {_r('idf', 'boost', 'prox')}, round(matched::double / n, {DIGITS}) coord, round(qn, {DIGITS}) qn, round(norm, {DIGITS}) norm,
         round(matched::double / n * qn * norm * idf * idf * boost * prox, {DIGITS}) contribution
  from c join docs_page d on d.doc_id = c.doc_id""")
def explain_scores(spark, sf):
    x = explain.explain_scores(*_asked(spark, sf, "page", QUERIES[1:2]))
    x = x.withColumnsRenamed({"proximity": "prox", "query_norm": "qn"}).drop("query_id")
    return _round(x, "idf", "boost", "prox", "coord", "qn", "norm", "contribution")


@query("search_json", _search_sql(QUERIES[:1]) + f""", l as (select formula_id, {LATEX} formula from i)
  select rank - 1 place, (select count(*) from r) total, formula_id, formula, page_id doc_id, title doc_title, {URL} doc_url, round(score, {DIGITS}) score
  from ranked join l using (formula_id) join pages using (page_id) where rank <= 5""")
def search_json_pages(spark, sf):
    """The JSON answer's items, without the time that it took."""
    answer = json.loads(search_json(corpus(spark, sf), "a + b", 1, 5))
    rows = [(n, answer["total"], x["doc"]["formula_id"], x["doc"]["formula"], x["doc"]["doc_id"], x["doc"]["doc_title"], x["doc"]["doc_url"], round(x["score"], DIGITS)) for n, x in enumerate(answer["results"])]
    return spark.createDataFrame(rows, "place int, total long, formula_id long, formula string, doc_id long, doc_title string, doc_url string, score double")


# --- segments -------------------------------------------------------------


def _segments(spark, sf) -> Segments:
    return Segments(spark, new_path(spark, "segments"))


def _parts(spark, sf, which: str):
    """Pages and formulas of the pages that satisfy ``which``."""
    return pages(spark, sf).where(which), formulas(spark, sf).where(which)


@query("segments_search", _search_sql(QUERIES[:1]) + f" select page_id, formula_id, {_r(*SCORES)} from r")
def segments_search(spark, sf):
    """A search over three segments, each with a third of the pages."""
    own = _segments(spark, sf)
    for k in range(3):
        own.append(*_parts(spark, sf, f"pmod(page_id, 3) = {k}"))
    return _round(search.search(*search.prepared(own.open(), QUERIES[:1])), *SCORES).drop("query_id")


def _replaced(spark, sf) -> Segments:
    """Segments of all pages, half of them first with other formulas; those are replaced, in two commits."""
    own = _segments(spark, sf)
    p, f = _parts(spark, sf, "true")
    stale = F.when(F.col("page_id") % 2 == 0, F.lit("x + y ^ b")).otherwise(F.col("latex"))
    own.append(p, f.withColumn("latex", stale))
    for k in (0, 2):
        own.append(*_parts(spark, sf, f"pmod(page_id, 4) = {k}"))
    return own


@query("segments_upsert", _search_sql(QUERIES[1:2]) + f" select page_id, formula_id, {_r(*SCORES)} from r")
def segments_upsert(spark, sf):
    """A search over segments of which one has pages that later ones replace: as if built at once."""
    return _round(search.search(*search.prepared(_replaced(spark, sf).open(), QUERIES[1:2])), *SCORES).drop("query_id")


@query("segments_merged", _base() + " select doc_id, term, array_to_string(levels, ',') levels, df from post_page join df_page using (term)")
def segments_merged(spark, sf):
    """Page postings and df after replaced pages and a merge."""
    own = _replaced(spark, sf)
    own.merge()
    i = own.open()
    levels = F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels")
    return i.postings["page"].join(i.term_stats["page"], "term").select("doc_id", "term", levels, "df")


@query("segments_stream", _search_sql(QUERIES[:1]) + f""", n as (select formula_id, page_id * 1048576 + row_number() over (partition by page_id order by formula_id) - 1 id from f)
  select page_id, id formula_id, {_r(*SCORES)} from r join n using (formula_id)""")
def segments_stream(spark, sf):
    """A search over what was ingested from a stream of pages, a segment for each batch, the first ones merged."""
    source, path = new_path(spark, "stream"), new_path(spark, "segments")
    _wiki_pages(spark, sf).repartition(3, "page_id").write.parquet(source)
    stream = spark.readStream.schema("page_id long, title string, text string").option("maxFilesPerTrigger", 1).parquet(source)
    ingest(stream, path, new_path(spark, "stream-state"), most=2).awaitTermination()
    return _round(search.search(*search.prepared(Segments(spark, path).open(), QUERIES[:1])), *SCORES).drop("query_id")


# --- labels ---------------------------------------------------------------

#: Labels: for each order the query of its customer's class, the order's url, relevance 0 to 5; 0 is no label.
LABELS = "labels0 as (select 'q' || (o_custkey % 50) query, 'u' || o_orderkey url, (o_orderkey % 6)::int relevance from orders), lab as (select * from labels0 where relevance <> 0)"


def _all_labels(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit("q"), F.col("o_custkey") % 50).alias("query"), F.concat(F.lit("u"), "o_orderkey").alias("url"), (F.col("o_orderkey") % 6).cast("int").alias("relevance"))


def _labels(spark, sf):
    return label_table.put(label_table.empty(spark), _all_labels(spark, sf))


@query("label_put", f"with {LABELS} select query, url, case when url like '%7' then 9 else relevance end relevance from labels0 where (url like '%7' or relevance <> 0) and not url like '%3'")
def label_put(spark, sf):
    changes = _all_labels(spark, sf).where("url like '%7' or url like '%3'")
    changes = changes.withColumn("relevance", F.when(F.col("url").like("%7"), 9).otherwise(0))
    return label_table.put(_labels(spark, sf), changes)


@query("label_delete", f"with {LABELS} select * from lab where not url like '%5'")
def label_delete(spark, sf):
    return label_table.delete(_labels(spark, sf), _all_labels(spark, sf).where("url like '%5'"))


@query("label_get_default", f"with {LABELS} select query, url, case when url like '%1' then 0 else relevance end relevance from labels0")
def label_get_default(spark, sf):
    known = _labels(spark, sf).where("not url like '%1'")
    return label_table.lookup(_all_labels(spark, sf).select("query", "url"), known)


@query("label_queries", f"with {LABELS} select distinct query from lab")
def label_queries(spark, sf):
    return label_table.all_queries(_labels(spark, sf))


@query("label_export", f"""with {LABELS} select query, '[' || string_agg('{{"url":"' || url || '","score":' || relevance || '}}', ',' order by url) || ']' labels from lab group by query""")
def label_export(spark, sf):
    return label_table.export(_labels(spark, sf))


@query("label_store", f"with {LABELS} select query, url, case when url like '%7' then 9 else relevance end relevance from labels0 where (url like '%7' or relevance <> 0) and not url like '%3'")
def label_store(spark, sf):
    """Labels after three commits to a store: all, some replaced, some taken out; compacted."""
    own = label_table.Store(spark, new_path(spark, "labels"))
    rows = _all_labels(spark, sf)
    own.put(rows)
    own.put(rows.where("url like '%7'").withColumn("relevance", F.lit(9)))
    own.put(rows.where("url like '%3'").withColumn("relevance", F.lit(0)))
    own.compact()
    return own.read()


# --- evaluation -----------------------------------------------------------

#: Ranked results of fifty queries: orders by price; relevance from the labels.
JUDGED = LABELS + """, j as (select 'q' || (o_custkey % 50) query, row_number() over (partition by o_custkey % 50 order by o_totalprice desc, o_orderkey) rank, (o_orderkey % 6)::int relevance from orders),
d as (select query, sum(case when relevance > 0 then (pow(2, relevance - 1) - 1) / log2(rank + 1) else 0 end) dcg, count(*) filter (relevance > 0) active,
  count(*) filter (relevance > 1) / 10.0::double as precision from j where rank <= 10 group by query)"""


def _judged(spark, sf):
    from pyspark.sql import Window as W

    o = table(spark, sf, "orders").select(F.concat(F.lit("q"), F.col("o_custkey") % 50).alias("query"), F.concat(F.lit("u"), "o_orderkey").alias("url"), "o_totalprice", "o_orderkey")
    order = W.partitionBy("query").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = o.withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    return label_table.lookup(top.select("query", "url", "rank"), _labels(spark, sf))


@query("dcg_at_k", f"with {JUDGED} select query, {_r('dcg')}, active from d")
def dcg_at_k(spark, sf):
    return _round(evaluate.quality(_judged(spark, sf), 10), "dcg").select("query", "dcg", "active")


@query("precision_at_k", f"with {JUDGED} select query, precision from d")
def precision_at_k(spark, sf):
    return evaluate.quality(_judged(spark, sf), 10).select("query", "precision")


@query("mean_dcg", f"with {JUDGED} select round(avg(dcg), {DIGITS}) dcg, round(avg(precision), {DIGITS}) as precision from d")
def mean_dcg(spark, sf):
    return _round(evaluate.mean_quality(evaluate.quality(_judged(spark, sf), 10)), "dcg", "precision")


@query("evaluate_labels", _search_sql() + f""", lq as (select * from (values {", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in QUERIES)}) v(query_id, query)),
  top as (select query, rank, (page_id % 6)::int relevance from ranked join lq using (query_id) where rank <= 10)
  select lq.query, round(coalesce(sum(case when relevance > 0 then (pow(2, relevance - 1) - 1) / log2(rank + 1) else 0 end), 0), {DIGITS}) dcg,
    count(*) filter (relevance > 0) active, count(*) filter (relevance > 1) / 10.0::double as precision from lq left join top using (query) group by lq.query""")
def evaluate_labels(spark, sf):
    """Search of labelled queries, results looked up among the labels, DCG and precision: all in one plan."""
    urls = pages(spark, sf).select(scoring.wiki_url(F.col("title")).alias("url"), (F.col("page_id") % 6).cast("int").alias("relevance"))
    names = spark.createDataFrame([(x,) for _, x in QUERIES], "query string")
    labels = names.crossJoin(urls)  # six fixed queries
    marks = names.select("query", F.lit("-").alias("url"), F.lit(1).alias("relevance"))  # a query without results is labelled too
    return _round(evaluate.evaluate(corpus(spark, sf), label_table.put(label_table.empty(spark), labels).unionByName(marks), 10), "dcg")


@query("latency_stats", f"select round(min(value), {DIGITS}) min, round(max(value), {DIGITS}) max, round(avg(value), {DIGITS}) avg, round(median(value), {DIGITS}) median, count(value) count from events")
def latency_stats(spark, sf):
    return _round(evaluate.latency(table(spark, sf, "events"), "value"), "min", "max", "avg", "median")


@query("ingest_counters", _base() + """ select (select count(*) from f) formulas, (select count(*) from f where formula_id % 16 = 2) errors,
  (select count(*) from e where formula_id % 16 <> 2) terms""")
def ingest_counters(spark, sf):
    f = formulas(spark, sf)
    broken = F.when(F.col("key") % 16 == 2, F.lit(r"\frac{a")).otherwise(F.col("latex"))
    return index_tables.counters(f.withColumn("latex", broken))


def _dump(pages: DataFrame) -> DataFrame:
    """Pages as rows of a MediaWiki dump."""
    text = F.struct(F.struct(F.lit(1).alias("_bytes"), F.col("text").alias("_VALUE")).alias("text")).alias("revision")
    return pages.select("title", F.col("page_id").alias("id"), text)


@query("xml_scan", _base() + " select page_id, title, count(formula_id)::int n_formulas from pages left join f using (page_id) group by page_id, title")
def xml_scan(spark, sf):
    """Pages written as a MediaWiki dump to the shared folder, scanned, and their formulas extracted."""
    path = new_path(spark, "dump")
    _dump(_wiki_pages(spark, sf)).write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    scanned = wiki.with_formulas(wiki.read_dump(spark, path))
    return scanned.select("page_id", "title", F.size("mathes").alias("n_formulas"))


@query("scan_early_stop", _base() + """, n as (select p.page_id, count(f.formula_id) n_formulas from pages p left join f using (page_id) group by p.page_id)
  select page_id, n_formulas from n qualify coalesce(sum(n_formulas) over (order by page_id rows between unbounded preceding and 1 preceding), 0) < 3000""")
def scan_early_stop(spark, sf):
    """A dump in files of rising ids, scanned until 3,000 formulas are found: the files after that stay unread."""
    path = new_path(spark, "dump")
    dump = _dump(_wiki_pages(spark, sf).repartitionByRange(12, "page_id").sortWithinPartitions("page_id"))
    dump.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    kept, _ = wiki.scan_until(spark, path, 3000, wave_bytes=1)
    return kept.select("page_id", F.col("n_formulas").cast("long").alias("n_formulas"))


@query("udtf_terms", _base() + " select formula_id, ord, term, level, gen generalization from e")
def udtf_terms(spark, sf):
    """Terms by the table function in SQL."""
    hooks.register(spark, "formula_terms")
    return spark.sql("select f.formula_id, t.* from {own} f, lateral formula_terms(f.latex) t", own=formulas(spark, sf))


_RENAMED = "replace(replace(term, {}, {}), {}, {})".format(*map(_quoted, ("o='*'", "o='&times;'", "o='+'", "o='&plus;'")))


@query("terms_rewritten", _base() + f" select formula_id, {_RENAMED} term, level, gen generalization from e")
def terms_rewritten(spark, sf):
    """Terms after a caller's rewrite: operators under other names."""
    own = Settings(rewrites=(hooks.renamed_operators({"*": "&times;", "+": "&plus;"}),))
    return explode_terms(formulas(spark, sf), settings=own).select("formula_id", "term", "level", "generalization")


_MEAN = "list_avg(list_transform(p.levels, lambda x: 1.0::double / (1 + abs(x - n.level))))"


@query("search_mean_fold", _search_sql(QUERIES[1:2], _MEAN) + f" select page_id, formula_id, {_r(*SCORES)} from r")
def search_mean_fold(spark, sf):
    """A search whose payloads are folded by their mean, as a caller asks."""
    own = Settings(fold=hooks.mean_proximity)
    return _round(search.search(*search.prepared(corpus(spark, sf), QUERIES[1:2], own), own), *SCORES).drop("query_id")


@query("postings_stored", _base() + """ select 'formula' kind, doc_id, page_id, term, array_to_string(levels, ',') levels from post_formula
  union all select 'page', doc_id, page_id, term, array_to_string(levels, ',') from post_page""")
def postings_stored(spark, sf):
    """Both kinds of postings as an index holds them that was written, read and opened."""
    path = new_path(spark, "index")
    index_tables.write(corpus(spark, sf), path)
    own = index_tables.read(spark, path)
    each = [own.postings[k].select(F.lit(k).alias("kind"), "doc_id", "page_id", "term", F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels")) for k in index_tables.KINDS]
    return each[0].union(each[1])


@query("terms_of_empty_formulas", _base() + """ select f.formula_id, (case when f.formula_id % 4 < 2 then 0 else count(e.term) end)::int n_terms, false is_error
  from f left join e using (formula_id) group by f.formula_id""")
def terms_of_empty_formulas(spark, sf):
    """Null and empty formulas among the others: they have no terms and are no errors."""
    f = formulas(spark, sf)
    empty = F.when(F.col("key") % 4 == 0, F.lit("")).when(F.col("key") % 4 != 1, F.col("latex"))
    return index_tables.analysed(f.withColumn("latex", empty)).select("formula_id", "n_terms", "is_error")


@query("dump_to_search", _search_sql(QUERIES[1:2]) + f""", n as (select formula_id, row_number() over (order by page_id, formula_id) id from f)
  select page_id, id formula_id, {_r(*SCORES)} from r join n using (formula_id)""")
def dump_to_search(spark, sf):
    """A dump scanned, numbered, indexed and searched, as the command line does it."""
    from .__main__ import build_index

    dump, out = new_path(spark, "dump"), new_path(spark, "out")
    _dump(_wiki_pages(spark, sf)).write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(dump)
    build_index(spark, dump, out, Settings(max_formula_count=None), say=lambda s: None)
    return _round(search.search(*search.prepared(index_tables.read(spark, f"{out}/index"), QUERIES[1:2])), *SCORES).drop("query_id")


@query("search_http", _search_sql(QUERIES[1:2]) + f""", l as (select formula_id, {LATEX} formula from i)
  select rank - 1 place, (select count(*) from r) total, formula_id, formula, page_id doc_id, title doc_title, {URL} doc_url, round(score, {DIGITS}) score
  from ranked join l using (formula_id) join pages using (page_id) where rank > 5 and rank <= 12""")
def search_http(spark, sf):
    """A page of results and a part of another, asked over HTTP."""
    import threading
    from urllib.parse import quote
    from urllib.request import urlopen

    from .__main__ import server

    http = server(corpus(spark, sf), None, 0, Settings())
    threading.Thread(target=http.serve_forever, daemon=True).start()
    try:
        ask = lambda page, size: json.loads(urlopen(f"http://127.0.0.1:{http.server_port}/api/search/{quote(QUERIES[1][1], safe='')}/{page}?size={size}").read())
        found = [(5 + n, ask_, x) for ask_ in [ask(2, 5)] for n, x in enumerate(ask_["results"])]
        found += [(10 + n, ask_, x) for ask_ in [ask(6, 2)] for n, x in enumerate(ask_["results"])]
    finally:
        http.shutdown()
        http.server_close()
    rows = [(n, a["total"], *(x["doc"][k] for k in ("formula_id", "formula", "doc_id", "doc_title", "doc_url")), round(x["score"], DIGITS)) for n, a, x in found]
    return spark.createDataFrame(rows, "place int, total long, formula_id long, formula string, doc_id long, doc_title string, doc_url string, score double")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of results for a batch of queries, with titles and links."""
    i, q = search.prepared(corpus(spark, sf), QUERIES)
    top = search.result_page(search.search(i, q), 1, 10)
    return search.with_attributes(i, top, most=10 * len(QUERIES)).orderBy("query_id", "rank")

