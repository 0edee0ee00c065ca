"""De-identification: fuzzy name-word matching inside an encounter, word windows, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions import text as tx
from caseflow.rules.vocab import DEID_WINDOW_WORDS

KEY = "encounter_id"


def name_words(names: DataFrame, name_col: str = "subject_name") -> DataFrame:
    """(key, name_word, tolerance): lower-cased name split on blanks and commas; the edit
    tolerance grows with word length (<4 → 0, <6 → 1, else 2)."""
    w = F.explode(F.split(F.lower(F.col(name_col)), "[\\s,.;]+")).alias("name_word")
    out = names.select(KEY, w).where(F.length("name_word") > 0).distinct()
    return out.withColumn("tolerance", F.when(F.length("name_word") < 4, 0)
                          .when(F.length("name_word") < 6, 1).otherwise(2))


def _normal(text_col: str):
    """Lower-cased text with runs of blanks collapsed."""
    return F.regexp_replace(F.lower(F.col(text_col)), " +", " ")


def _word_runs(text):
    """Runs of letters, digits and inner marks (``o'neil`` stays whole but for a possessive
    ``'s``), and the runs between them: joined, they are the text again."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}\p{N}]+(?:['’-](?!s\b)[\p{L}\p{M}\p{N}]+)*|[^\p{L}\p{M}\p{N}]+"), F.lit(0))


_IS_WORD = r"^[\p{L}\p{M}\p{N}]"


def note_words(notes: DataFrame, text_col: str = "note_text") -> DataFrame:
    """The words of the normalised text, exploded to (key, pos, word); ``pos`` counts words."""
    words = F.filter(_word_runs(_normal(text_col)), lambda w: w.rlike(_IS_WORD))
    return notes.select(KEY, F.posexplode(words).alias("pos", "word"))


def fuzzy_name_matches(notes: DataFrame, names: DataFrame, text_col: str = "note_text",
                       name_col: str = "subject_name") -> DataFrame:
    """Word positions whose word is within the tolerance of a name word of the same
    encounter: an equi-join on the encounter key plus a bounded edit-distance filter."""
    nw = name_words(names, name_col)
    words = note_words(notes, text_col)
    return (words.join(nw, KEY, "inner")
            .where(F.levenshtein("name_word", "word", 2).between(0, F.col("tolerance")))
            .select(KEY, "pos", "word", "name_word"))


def deidentify(notes: DataFrame, names: DataFrame, text_col: str = "note_text",
               name_col: str = "subject_name", replace_with: str = "pt") -> DataFrame:
    """Lower-case, collapse blanks, replace every word matching a name word by
    ``replace_with``, then redact record numbers and birth dates.

    Words are runs of letters and digits, so a name next to a comma, a full stop, a line
    break or a possessive is found and what stands around it stays. The names of an encounter
    are one short array, joined once to the note; the words are compared in place."""
    name = F.struct(F.col("name_word").alias("w"), F.col("tolerance").alias("t"))
    per = name_words(names, name_col).groupBy(KEY).agg(F.collect_set(name).alias("_names"))
    runs = _word_runs(_normal(text_col))
    hit = lambda w: F.coalesce(w.rlike(_IS_WORD) & F.exists(
        "_names", lambda n: F.levenshtein(n["w"], w, 2).between(0, n["t"])), F.lit(False))
    replaced = F.array_join(F.transform(runs, lambda w: F.when(hit(w), F.lit(replace_with)).otherwise(w)), "")
    return (notes.join(per, KEY, "left")
            .select(KEY, tx.redact_identifiers(replaced, replace_with).alias("note_text")))


def word_windows(df: DataFrame, text_col: str = "note_text", max_words: int = DEID_WINDOW_WORDS) -> DataFrame:
    """Split long texts into n near-equal word windows: n = ceil(len / max), size = ceil(len / n)."""
    words = F.split(F.col(text_col), " ")
    n = F.ceil(F.size(words) / F.lit(max_words))
    size = F.ceil(F.size(words) / n)
    wins = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")),
                       lambda i: F.array_join(F.slice(words, (i * size + 1).cast("int"), size.cast("int")), " "))
    return df.select(KEY, F.posexplode(wins).alias("window_no", "window_text"))


def check_single_name(names: DataFrame, name_col: str = "subject_name") -> DataFrame:
    """Encounters carrying more than one distinct subject name (an input error)."""
    return (names.groupBy(KEY).agg(F.count_distinct(name_col).alias("n_names"))
            .where(F.col("n_names") > 1))
