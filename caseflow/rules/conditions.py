"""Conditions over a lower-cased text, as data: combined with & and |, read as SQL."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Condition:
    """A boolean SQL expression in which ``{c}`` stands for the text column."""

    text: str

    def __and__(self, other: Condition) -> Condition:
        return Condition(f"({self.text} AND {other.text})")

    def __or__(self, other: Condition) -> Condition:
        return Condition(f"({self.text} OR {other.text})")

    def sql(self, column: str) -> str:
        return self.text.replace("{c}", column)


def _each(words, link: str) -> str:
    return "(" + link.join("contains({c}, '%s')" % w.replace("'", "\\'") for w in words) + ")"


def has(*words: str) -> Condition:
    return Condition(_each(words, " OR "))


def has_all(*words: str) -> Condition:
    return Condition(_each(words, " AND "))


def lacks(*words: str) -> Condition:
    return Condition(f"(NOT {_each(words, ' OR ')})")


def length_is(n: int) -> Condition:
    return Condition("(length({c}) = %d)" % n)
