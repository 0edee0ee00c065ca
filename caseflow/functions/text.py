"""Text column expressions: whitespace, abbreviation expansion, search terms, redaction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.rules.stopwords import ENGLISH_STOP_WORDS
from caseflow.rules.vocab import ABBREVIATIONS

WORD_EDGE = "a-zA-Z0-9"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c) -> Column:
    """Split on any whitespace and re-join with one blank."""
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def _java_replacement(s: str) -> str:
    # In a Java replacement string ``\`` and ``$`` are special: escape both.
    return s.replace("\\", "\\\\").replace("$", "\\$")


def _regex_fold(c: Column, terms: list[tuple[str, str]]) -> Column:
    """Each term in turn through a built-in ``regexp_replace`` with look-around edges,
    skipped by a plain substring test when the term is absent. Patterns are literals, so
    each is compiled once per task."""
    def step_for(term: str, pat: str, rep: str):
        return lambda acc, _unused: F.when(F.instr(acc, term) > 0, F.regexp_replace(acc, pat, rep)).otherwise(acc)

    out = c
    for term, repl in terms:
        pat = f"(?<![{WORD_EDGE}]){re.escape(term)}(?![{WORD_EDGE}])"
        # a one-element fold binds the running text to a variable, so the guard and
        # the replacement share it instead of copying the expression tree
        out = F.aggregate(F.array(F.lit(0)), out, step_for(term, pat, _java_replacement(repl)))
    return out


def _single_run(term: str) -> bool:
    return re.fullmatch(f"[{WORD_EDGE}]+", term) is not None


def _run_lookup_is_exact(terms: list[tuple[str, str]]) -> bool:
    """True when replacing whole letter/digit runs in one pass equals the ordered chain:
    no expansion contains a later term as a whole run, no multi-run term can be touched
    by a single-run term, and no expansion can create a multi-run term."""
    keys = [k for k, _ in terms]
    pos = {k: i for i, k in enumerate(keys)}
    exp = dict(terms)
    for i, (_, v) in enumerate(terms):
        runs = set(re.findall(f"[{WORD_EDGE}]+", v))
        if runs & set(keys[i + 1:]):
            return False
    for k in keys:
        if _single_run(k):
            continue
        if any(k in v for _, v in terms):
            return False
        for r in set(re.findall(f"[{WORD_EDGE}]+", k)):
            if r not in pos or pos[r] > pos[k]:
                continue  # multi-run terms go first, so a later single-run term is fine
            # an earlier single-run term that prefixes k must expand k the same way
            suffix = k[len(r):]
            if not (k.startswith(r) and exp[k] == exp[r] + suffix):
                return False
    return True


def _one_pass_is_exact(terms: list[tuple[str, str]]) -> bool:
    """True when the multi-run terms in order, then all single-run terms in one pass over the runs, equal
    the ordered chain: besides ``_run_lookup_is_exact``, no expansion of a multi-run term holds a
    single-run term (which the pass would expand again), and no term is listed twice."""
    single = {k for k, _ in terms if _single_run(k)}
    return (_run_lookup_is_exact(terms) and len({k for k, _ in terms}) == len(terms)
            and not any(single & set(re.findall(f"[{WORD_EDGE}]+", v)) for k, v in terms if not _single_run(k)))


def _expand_runs(c: Column, terms: list[tuple[str, str]]) -> Column:
    """One pass: the text is cut into letter/digit runs and what lies between, and each run that is a
    term is looked up in a literal map."""
    single = [(k, v) for k, v in terms if _single_run(k)]
    out = _regex_fold(c, [(k, v) for k, v in terms if not _single_run(k)])
    table = F.create_map(*[F.lit(x) for kv in single for x in kv])
    # the set test comes first: it is a hash look-up, the map a search through its keys
    keys = [k for k, _ in single]
    runs = F.regexp_extract_all(out, F.lit(f"[{WORD_EDGE}]+|[^{WORD_EDGE}]+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.when(r.isin(keys), F.try_element_at(table, r)).otherwise(r)), "")


def _alternation(terms: list[str]) -> str:
    """Terms as one alternation grouped by first character (longest first inside a
    group), behind a one-character look-ahead, with word edges."""
    groups: dict[str, list[str]] = {}
    for t in sorted(set(terms), key=lambda x: (-len(x), x)):
        groups.setdefault(t[0], []).append(t)
    first = "".join(re.escape(ch) for ch in sorted(groups))
    alt = "|".join(f"{re.escape(ch)}(?:{'|'.join(re.escape(x[1:]) for x in grp)})" for ch, grp in sorted(groups.items()))
    return f"(?=[{first}])(?<![{WORD_EDGE}])(?:{alt})(?![{WORD_EDGE}])"


def expand_terms(c, terms: list[tuple[str, str]] | None = None) -> Column:
    """Replace every dictionary term that is not glued to an ASCII letter/digit, one term
    after the other in dictionary order, case-sensitively.

    Where that is the same (``_one_pass_is_exact``, as for the built-in dictionary), runs of letters
    and digits are looked up in one pass. Else, one regex pass lists the terms present at word
    edges, and the chain of built-in ``regexp_replace`` steps runs over those only, which are few in a
    text; that is exact when no expansion can create a term (``_run_lookup_is_exact``). Else every step runs.
    """
    terms = terms or ABBREVIATIONS
    c = _c(c)
    if any(_single_run(k) for k, _ in terms) and _one_pass_is_exact(terms):
        return _expand_runs(c, terms)
    if not _run_lookup_is_exact(terms):
        return _regex_fold(c, terms)
    rules = F.array(*[F.struct(F.lit(k).alias("k"),
                               F.lit(f"(?<![{WORD_EDGE}]){re.escape(k)}(?![{WORD_EDGE}])").alias("pat"),
                               F.lit(_java_replacement(v)).alias("rep")) for k, v in terms])
    present = F.array_distinct(F.regexp_extract_all(c, F.lit(_alternation([k for k, _ in terms])), 0))
    # bound to a variable, so that the list is made once per text and not once per rule
    todo = F.element_at(F.transform(F.array(present), lambda found: F.filter(rules, lambda r: F.array_contains(found, r["k"]))), 1)
    return F.aggregate(todo, c, lambda text, r: F.regexp_replace(text, r["pat"], r["rep"]))


def stop_words() -> Column:
    return F.array(*[F.lit(w) for w in ENGLISH_STOP_WORDS])


def search_terms(c) -> Column:
    """Distinct lower-case ASCII word terms of a text, stop words removed (no stemming)."""
    toks = F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.array_except(toks, stop_words()))


def token_list(c) -> Column:
    """All lower-case ASCII word tokens, with repeats, stop words removed (for term frequency)."""
    toks = F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z0-9]+"), 0)
    sw = stop_words()
    return F.filter(toks, lambda t: ~F.array_contains(sw, t))


def redact_identifiers(c, replace_with: str = "pt") -> Column:
    """Record numbers → ``[redacted]``; `` dob`` followed by a d/m/y date → replacement."""
    out = F.regexp_replace(_c(c), "mrn(:| )*[0-9]+", "[redacted]")
    return F.regexp_replace(out, " dob(:| )*[0-9]+/[0-9]+/[0-9]+", _java_replacement(replace_with))


def split_words(c) -> Column:
    return F.split(_c(c), " ")
