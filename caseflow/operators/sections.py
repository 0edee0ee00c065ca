"""Section cutting: find header literals, cut a text into (category, body) pieces,
keep wanted categories first, then unlabelled ones, drop unwanted ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.rules.sections import KEEP_SECTIONS, REMOVE_SECTIONS, header_to_category

EDGE = "A-Za-z0-9"


def header_pattern(literals: list[str] | None = None, ignore_case: bool = False) -> str:
    """One alternation of every header literal, longest first so that a longer header
    wins over its prefix, with word edges on both sides.

    For speed the alternation is grouped by first character, behind a one-character
    look-ahead: at most text positions a single character-class test fails and no
    literal is tried. Grouping keeps the longest-first order inside each group, and
    only literals starting with the current character can match there, so the match
    is the same as with the flat alternation.
    """
    lits = set(literals or header_to_category())
    lits = sorted({x.lower() for x in lits} if ignore_case else lits, key=lambda s: (-len(s), s))
    groups: dict[str, list[str]] = {}
    for lit in lits:
        groups.setdefault(lit[0], []).append(lit)
    first = "".join(re.escape(ch) + (ch.upper() if ignore_case else "") for ch in sorted(groups))
    alt = "|".join(f"{re.escape(ch)}(?:{'|'.join(re.escape(x[1:]) for x in grp)})"
                   for ch, grp in sorted(groups.items()))
    case = "(?i)" if ignore_case else ""
    return f"{case}(?=[{first}])(?<![{EDGE}])(?:{alt})(?![{EDGE}])"


def _category_map(ignore_case: bool) -> Column:
    m: dict[str, str] = {}
    for literal, category in header_to_category().items():
        m.setdefault(literal.lower() if ignore_case else literal, category)
    return F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])


def section_parts(text: Column, ignore_case: bool = False) -> Column:
    """Array of structs (category, body) in text order; the part before the first header
    has a null category. A colon right after a header belongs to the header. With
    ``ignore_case``, headers match in any case, and the first rule of a spelling counts."""
    pat = header_pattern(ignore_case=ignore_case)
    headers = F.regexp_extract_all(text, F.lit(pat), 0)
    bodies = F.split(text, pat, -1)
    cmap = _category_map(ignore_case)
    cats = F.concat(F.array(F.lit(None).cast("string")), F.transform(
        headers, lambda h: F.element_at(cmap, F.lower(h) if ignore_case else h)))
    zipped = F.arrays_zip(cats.alias("category"), bodies.alias("body"))
    return F.transform(zipped, lambda z: F.struct(
        z["category"].alias("category"),
        F.trim(F.regexp_replace(z["body"], r"^\s*:?\s*", "")).alias("body")))


def filter_sections(df: DataFrame, text_col: str, out: str = "text", keep: list[str] | None = None,
                    remove: list[str] | None = None, keep_unlabelled: bool = True,
                    ignore_case: bool = False) -> DataFrame:
    """Kept sections first (text order), then unlabelled ones; joined by a blank.

    The cut is materialised as one column first, so the header regex runs once per
    text however many times the parts are read afterwards.
    """
    keep = keep or KEEP_SECTIONS
    remove = remove or REMOVE_SECTIONS
    karr = F.array(*[F.lit(c) for c in keep])
    known = F.array(*[F.lit(c) for c in keep + remove])
    staged = df.withColumn("_parts", F.filter(section_parts(F.col(text_col), ignore_case), lambda p: F.length(p["body"]) > 0))
    kept = F.transform(F.filter("_parts", lambda p: F.coalesce(F.array_contains(karr, p["category"]), F.lit(False))),
                       lambda p: p["body"])
    if keep_unlabelled:
        unl = F.transform(F.filter("_parts", lambda p: p["category"].isNull() | ~F.array_contains(known, p["category"])),
                          lambda p: p["body"])
        kept = F.concat(kept, unl)
    return staged.withColumn(out, F.array_join(kept, " ")).drop("_parts")


def section_profile(df: DataFrame, text_col: str) -> DataFrame:
    """Number of header occurrences per category over a corpus."""
    parts = F.slice(section_parts(F.col(text_col)), 2, 1 << 30)
    return (df.select(F.explode(parts).alias("p")).select(F.col("p.category").alias("category"))
            .groupBy("category").agg(F.count(F.lit(1)).alias("n_sections")))
