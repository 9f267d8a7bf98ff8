"""Text normalisation and token expressions, all built from Catalyst functions.

Null texts are treated as empty, so every expression is defined for every row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def normalize_default(text: Column) -> Column:
    """Lower-case ASCII words and numbers of more than one character, with single spaces."""
    spaced = F.lower(F.regexp_replace(filled(text), "[^A-Za-z0-9]+", " "))
    return F.trim(F.regexp_replace(spaced, "(^| )[a-z0-9](?= |$)", ""))


def mark_numbers(text: Column) -> Column:
    """Runs of digits with the non-word characters around them become ' NUM '."""
    return F.regexp_replace(filled(text), "[^A-Za-z0-9_]*[0-9]+[^A-Za-z0-9_]*", " NUM ")


def words_only(text: Column) -> Column:
    """Numbers marked, all other non-word characters dropped, single spaces, lower case."""
    bare = F.regexp_replace(mark_numbers(text), "[^A-Za-z0-9_]+", " ")
    return F.lower(F.trim(bare))


def letters_only(text: Column) -> Column:
    """Everything but ASCII letters becomes a space; lower case, no outer spaces."""
    return F.trim(F.lower(F.regexp_replace(filled(text), "[^A-Za-z]+", " ")))


def strip_tags(text: Column) -> Column:
    """Mentions (' @name ') become a space, and words before a closing bracket go."""
    return F.regexp_replace(F.regexp_replace(filled(text), " @[^ ]* ", " "), r"[A-Za-z0-9_]+\]", "")


def squeeze(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) pairs in order, again and again until nothing changes.

    Texts that don't settle in two passes get as many more as they have
    characters, enough for pairs that shorten; each of these changes nothing
    once the text is settled.
    """

    def once(x: Column) -> Column:
        for pattern, to in patterns:
            x = F.regexp_replace(x, pattern, to)
        return x

    out = once(once(filled(text)))
    more = F.when((once(out) == out) | (F.length(out) == 0), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.length(out)))
    return F.aggregate(more, out, lambda x, _: once(x))


def shorten_runs(text: Column) -> Column:
    """Three or more of one word character become two."""
    return F.regexp_replace(filled(text), r"([A-Za-z0-9_])\1{2,}", "$1$1")


def tokens(text: Column) -> Column:
    """Split at single spaces; empty strings between spaces are tokens, and '' has one."""
    return F.split(filled(text), " ", -1)


def first_word(text: Column) -> Column:
    return F.element_at(tokens(text), 1)


def first_normal_word(text: Column) -> Column:
    """The first word of normalize_default(), found without normalising what follows it."""
    return F.lower(F.regexp_extract(filled(text), "[A-Za-z0-9]{2,}", 0))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.regexp_replace(filled(text), r"[ \t\r\n]+", " "), " "), lambda x: x != ""))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def sentiment_value(label: Column) -> Column:
    return F.when(label == "positive", 1).when(label == "negative", -1).when(label == "neutral", 0)


def rating_value(rating: Column) -> Column:
    return (rating.cast("double") - 3) * 0.5


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    """Logistic link; its argument is kept within 35 of zero."""
    return 1 / (1 + F.exp(-clip(x, -35.0, 35.0)))


def deletions(word: Column, order: int) -> Column:
    """All distinct strings that deleting 1 to ``order`` characters leaves, without the word itself."""

    def once(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, 1, i - 1), w.substr(i + 1, F.length(w))))

    def safely(w: Column) -> Column:
        return F.when(F.length(w) > 0, once(w)).otherwise(F.array().cast("array<string>"))

    level = safely(word)
    found = level
    for _ in range(order - 1):
        level = F.array_distinct(F.flatten(F.transform(level, safely)))
        found = F.concat(found, level)
    return F.array_distinct(F.filter(found, lambda x: x != word))
