"""Word stems by suffix stripping, as SQL expressions over a table of distinct terms.

Each step is one ``CASE`` over the word of the step before; no step runs in Python. The stemmer is meant
for the table of *distinct* terms, which is then joined to the texts: a term that all texts hold is
stemmed once. The steps are written once for two dialects, Spark and
the SQL of the checks; only regular-expression calls differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.rules import stems as R

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
SHORT = f"({OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"  # a short syllable ends the word


def _match(w: str, pattern: str, dialect: str) -> str:
    return f"({w} RLIKE '{pattern}')" if dialect == "spark" else f"regexp_matches({w}, '{pattern}')"


def _ends(suffix: str) -> str:
    return f"w LIKE '%{suffix}'"


def _cut(n: int, add: str = "") -> str:
    return f"concat(left(w, length(w) - {n}), '{add}')" if add else f"left(w, length(w) - {n})"


def _in(region: int, n: int) -> str:
    return f"length(w) - {n} >= r{region}"


def _case(rows: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rows) + " ELSE w END"


def steps(dialect: str = "spark") -> list[str]:
    """The word (``w``, regions ``r1`` and ``r2``) after each step."""
    m = lambda w, p: _match(w, p, dialect)
    when = lambda cond, yes: f"CASE WHEN {cond} THEN {yes} ELSE w END"
    plural = _case([(_ends("sses"), _cut(2)), (f"({_ends('ies')} OR {_ends('ied')})", f"CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END"),
                    (f"({_ends('us')} OR {_ends('ss')})", "w"), (f"({_ends('s')} AND {m('w', VOWEL + '.+s$')})", _cut(1))])
    kept = "w IN (" + ", ".join(f"'{x}'" for x in R.KEPT_AFTER_PLURAL) + ")"
    # a stripped ending leaves a mark, so that the next step knows whether to mend the end
    past = _case([(kept, "w"), (_ends("eedly"), when(_in(1, 5), _cut(3))), (_ends("ingly"), when(m("left(w, length(w) - 5)", VOWEL), _cut(5, "#"))),
                  (_ends("edly"), when(m("left(w, length(w) - 4)", VOWEL), _cut(4, "#"))), (_ends("eed"), when(_in(1, 3), _cut(1))),
                  (_ends("ing"), when(m("left(w, length(w) - 3)", VOWEL), _cut(3, "#"))), (_ends("ed"), when(m("left(w, length(w) - 2)", VOWEL), _cut(2, "#")))])
    mend = _case([(f"NOT {_ends('#')}", "w"), (m("w", "(at|bl|iz)#$"), _cut(1, "e")), (m("w", "(bb|dd|ff|gg|mm|nn|pp|rr|tt)#$"), _cut(2)),
                  (f"({m('left(w, length(w) - 1)', SHORT)} AND r1 >= length(w) - 1)", _cut(1, "e")), (_ends("#"), _cut(1))])
    final_y = _case([(f"({m('w', '^.+' + OTHER + '[yY]$')} AND NOT {kept})", _cut(1, "i"))])
    before = lambda n, letters: f" AND {m('left(w, length(w) - %d)' % n, '[' + letters + ']$')}" if letters else ""
    two = _case([(_ends(s), when(_in(1, len(s)) + before(len(s), b), _cut(len(s), to))) for s, to, b in R.STEP_2])
    three = _case([(_ends(s), when(_in(1, len(s)) + (f" AND {_in(2, len(s))}" if region == 2 else ""), _cut(len(s), to))) for s, to, region in R.STEP_3])
    four = _case([(_ends(s), when(_in(2, len(s)) + before(len(s), b), _cut(len(s)))) for s, b in R.STEP_4])
    five = _case([(_ends("e"), when(f"({_in(2, 1)} OR ({_in(1, 1)} AND NOT {m('left(w, length(w) - 1)', SHORT)}))", _cut(1))),
                  (_ends("l"), when(f"({_in(2, 1)} AND {_ends('ll')})", _cut(1)))])
    rest = [f"CASE WHEN {kept} THEN w ELSE {x} END" for x in (two, three, four, five)]
    return [plural, past, mend, final_y, *rest]


def _region(w: str) -> str:
    """Letters up to and with the first consonant after a vowel; all of them where there is none."""
    found = f"length(regexp_extract({w}, '^(.*?{VOWEL}{OTHER})', 1))"
    return f"CASE WHEN {found} = 0 THEN length({w}) ELSE {found} END"


def _marked(dialect: str) -> str:
    """The term with a consonant y as Y: at the start and after a vowel."""
    back, every = ("$1", "") if dialect == "spark" else ("\\1", ", 'g'")
    return f"regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiouy])y', '{back}Y'{every})"


def _first_region() -> str:
    prefix = " ".join(f"WHEN w LIKE '{p}%' THEN {len(p)}" for p in R.REGION_PREFIXES)
    return f"CASE {prefix} ELSE {_region('w')} END"


SECOND_REGION = f"r1 + {_region('substr(w, r1 + 1)')}"


def _final(stem: str) -> str:
    special = " ".join(f"WHEN term = '{k}' THEN '{v}'" for k, v in R.SPECIAL.items())
    return f"CASE WHEN length(term) < 3 THEN term {special} ELSE lower({stem}) END"


def stem_sql(terms: str) -> str:
    """The SQL of the checks: (term, stem) for a query ``terms`` with a column ``term``."""
    sql = f"SELECT term, {_marked('duckdb')} AS w FROM ({terms}) t0"
    sql = f"SELECT term, w, {_first_region()} AS r1 FROM ({sql}) t1"
    sql = f"SELECT term, w, r1, {SECOND_REGION} AS r2 FROM ({sql}) t2"
    for i, step in enumerate(steps("duckdb")):
        sql = f"SELECT term, {step} AS w, r1, r2 FROM ({sql}) s{i}"
    return f"SELECT term, {_final('w')} AS stem FROM ({sql}) s"


def stem_expression() -> str:
    """The stem of a column ``term``, as one Spark SQL expression. Each step is a lambda over the state
    (w, r1, r2) of the step before: it names the state as often as it likes, and the expression
    before is there once."""
    def bind(expression: str) -> str:
        return re.sub(r"(?<![\w'])(w|r1|r2)\b(?!')", r"s.\1", expression)

    def then(state: str, w: str = "w", r1: str = "r1", r2: str = "r2") -> str:
        return f"transform(array({state}), s -> named_struct('w', {bind(w)}, 'r1', {bind(r1)}, 'r2', {bind(r2)}))[0]"
    state = f"named_struct('w', {_marked('spark')}, 'r1', 0, 'r2', 0)"
    state = then(state, r1=_first_region())
    state = then(state, r2=SECOND_REGION)
    for step in steps("spark"):
        state = then(state, step)
    return _final(f"({state}).w")


def stem_table(terms: DataFrame) -> DataFrame:
    """(term, stem) of the distinct terms in ``terms`` (term: lower-case letters and digits)."""
    return terms.select("term").distinct().select("term", F.expr(stem_expression()).alias("stem"))


def text_terms(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, term): the distinct terms of each text, without stop words."""
    from caseflow.rules.stopwords import ENGLISH_STOP_WORDS
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z0-9]+"), 0))
    return df.select(key, F.explode(tokens).alias("term")).where(~F.col("term").isin(ENGLISH_STOP_WORDS))


def stemmed_terms(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, stem): the distinct stems of each text, stop words left out before."""
    rows = text_terms(df, key, text_col)
    return rows.join(stem_table(rows), "term").select(key, "stem").distinct()
