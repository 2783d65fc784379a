"""Text expressions: every function maps a column to a column and stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyloom.functions.words import ALIASES, stop_words

# Whitespace as Unicode text handling sees it; Java's \s alone is ASCII.
SPACE = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Phrases of an undecided answer.
UNCERTAIN = [
    r"\bnot sure\b", r"\bunsure\b", r"\bidk\b", r"\bi don't know\b",
    r"\bcannot decide\b", r"\bcan't decide\b", r"\bno idea\b",
]
# Phrases and figures of a zero answer.
ZERO = [r"\b0+\b", r"\bzero\b", r"\bnothing\b", r"\bno money\b", r"\bfree\b"]
# A zero that is the whole number, not a group of thousands or a decimal part.
ZERO_STRICT = [r"(?<![0-9][.,])\b0+\b(?![.,][0-9])", *ZERO[1:]]


def let(value: Column, body) -> Column:
    """Bind ``value`` to one lambda variable, so an expensive expression is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _swap(c: Column, pairs: Mapping[str, str]) -> Column:
    # replace() works on bytes and is several times faster than translate()
    for old, new in pairs.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def normalize_text(c: Column) -> Column:
    s = _swap(F.lower(F.coalesce(c, F.lit(""))), {"\u2013": "-", "\u2014": "-"})
    # the look-ahead rules out printable characters before the wide class is tried
    return F.trim(F.regexp_replace(s, rf"(?![!-~\u00a1-\u167f])[{SPACE}]+", " "))


def collapse_spaced_thousands(c: Column) -> Column:
    """``5 000 000`` -> ``5000000``.

    A blank goes when a whole group of one to three digits, or a blank removed
    just before, precedes it and exactly three digits follow.
    """
    return F.regexp_replace(
        c, r"(?:(?<![0-9])([0-9]{1,3})|\G([0-9]{3})) (?=[0-9]{3}(?![0-9]))", "$1$2"
    )


def contains_any(c: Column, patterns: Iterable[str], guard: str = "") -> Column:
    """Whether any pattern matches; word bounds follow Unicode letters.

    ``guard`` may name, as a look-ahead, what every match starts with; it is
    tested before the word bounds and must not rule out a match.
    """
    return c.rlike(f"(?U){guard}(?:" + "|".join(patterns) + ")")


def looks_uncertain(c: Column) -> Column:
    # the first letters of these phrases
    return contains_any(c, UNCERTAIN, "(?=[cinu])")


def looks_zero(c: Column, strict: bool = False) -> Column:
    return contains_any(c, ZERO_STRICT if strict else ZERO)


def singularize(t: Column, aliases: Mapping[str, str] = ALIASES) -> Column:
    n = F.length(t)
    rule = (
        F.when(~t.endswith("s") | (n <= 3), t)
        .when(t.endswith("ies") & (n > 4), F.concat(F.left(t, n - 3), F.lit("y")))
        .when(t.endswith("es") & (n > 4) & ~t.endswith("ses"), F.left(t, n - 2))
        .when(~t.endswith("ss"), F.left(t, n - 1))
        .otherwise(t)
    )
    if not aliases:
        return rule
    forms = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.when(t.isin(list(aliases)), F.try_element_at(forms, t)).otherwise(rule)


def raw_words(c: Column) -> Column:
    """Lower-case words of letters and inner apostrophes, before any word rule."""
    s = F.lower(F.coalesce(c, F.lit("missing")))
    s = _swap(s, {"\u2019": "'", "\u2018": "'", "-": " "})
    s = F.btrim(s, F.lit("'"))
    return F.array_remove(F.split(s, "'*[^a-z']+'*"), "")


def sql_strings(values: Iterable[str]) -> str:
    """String literals for an expression text."""
    quoted = [v.replace("\\", "\\\\").replace("'", "\\'") for v in values]
    return ", ".join(f"'{v}'" for v in quoted)


def keep_in(tokens: Column, words: Iterable[str], min_len: int = 0, inside: bool = True) -> Column:
    """Tokens that are (or are not) in a word list.

    The predicate is one expression text: a call per word would cost more than
    planning the query.
    """
    words = list(words)
    test = f"length(t) >= {min_len}"
    if words:
        test += f" AND t {'' if inside else 'NOT '}IN ({sql_strings(words)})"
    elif inside:
        test = "false"
    return F.call_function("filter", tokens, F.expr(f"t -> {test}"))


def _shape(words: Column, min_len: int, stops: Iterable[str] | None) -> Column:
    forms = F.transform(words, lambda t: singularize(t))
    return keep_in(forms, stop_words() if stops is None else stops, min_len, inside=False)


def tokenize(c: Column, min_len: int = 2, stops: Iterable[str] | None = None) -> Column:
    """All tokens in text order."""
    return _shape(raw_words(c), min_len, stops)


def distinct_tokens(c: Column, min_len: int = 2, stops: Iterable[str] | None = None) -> Column:
    """Distinct tokens; repeats are dropped before the word rules, which then run once per word."""
    return F.array_distinct(_shape(F.array_distinct(raw_words(c)), min_len, stops))


def vocab_tokens(c: Column, **kwargs) -> Column:
    """Distinct tokens that may enter a vocabulary: the missing marker never does."""
    return F.array_remove(distinct_tokens(c, **kwargs), "missing")


def split_multiselect(c: Column, sep: str = ",") -> Column:
    """Chosen options of a multi-select cell; NULL, empty and "missing" give an empty list."""
    parts = F.transform(
        F.split(F.coalesce(c, F.lit("")), "\\Q" + sep + "\\E"),
        lambda p: F.regexp_replace(p, f"^[{SPACE}]+|[{SPACE}]+$", ""),
    )
    return F.filter(parts, lambda p: (p != "") & (F.lower(p) != "missing"))


def hit_count(tokens: Column, vocab: Iterable[str]) -> Column:
    """Distinct tokens that are in ``vocab``."""
    return F.size(keep_in(F.array_distinct(tokens), vocab))
