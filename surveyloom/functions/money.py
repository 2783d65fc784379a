"""Amounts of money from free text, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyloom.functions.text import (
    collapse_spaced_thousands,
    contains_any,
    let,
    looks_zero,
    normalize_text,
)
from surveyloom.schema import PAYMENT_CAP

# Cells that hold no answer.
NO_ANSWER = ["", "nan", "n/a", "na", "none"]
# Scale words.
SCALES = {
    "k": 1e3, "thousand": 1e3, "mil": 1e6, "million": 1e6, "b": 1e9, "billion": 1e9,
}
# Phrases near an amount that speak for it, and against it.
REALISTIC = [
    r"\bmax\b", r"\bat most\b", r"\bno more than\b", r"\bwould pay\b", r"\bi'd pay\b",
    r"\bwilling to pay\b", r"\bbecause i'm not\b", r"\bbecause i am not\b", r"\brealistically\b",
]
HYPOTHETICAL = [
    r"\bif i were\b", r"\bif i was\b", r"\bif i had\b", r"\bbillionaire\b",
    r"\bin a perfect world\b",
]
# Fixed value: characters of context on each side of an amount.
CONTEXT = 35

# A letter, digit or underscore of any script.
_WORD = r"[\p{L}\p{N}_]"
_NUM = r"((?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?)"
# The five written forms of an amount, first match wins.
AMOUNT_FORMS = [
    # currency sign or code first
    rf"(?:cad\s*\$?|\$|usd\s*\$?)\s*{_NUM}\s*(k|thousand|mil|million|b|billion)?",
    # currency word last
    rf"{_NUM}\s*(k|thousand|mil|million|b|billion)?\s*(?:cad|usd|dollars?|bucks?)(?!{_WORD})",
    # scale word apart
    rf"{_NUM}\s+(k|thousand|mil|million|b|billion)(?!{_WORD})",
    # scale letter attached
    rf"{_NUM}(k|mil|b)(?!{_WORD})",
    # bare number
    rf"(?<!{_WORD}){_NUM}(?!{_WORD})",
]
# Groups: 1 context before, then number and scale of each form (2..10), 11 context after.
# The first look-ahead lets the scan skip characters no amount starts with.
AMOUNT = (
    r"(?s)(?=[0-9$cu])"
    rf"(?<=(^.{{0,{CONTEXT - 1}}}|.{{{CONTEXT}}}))"
    r"(?:" + "|".join(AMOUNT_FORMS) + r")"
    rf"(?=(.{{0,{CONTEXT}}}))"
)
# Private characters that set the parts of a match off; in a text they become the third.
_START, _NEXT, _OTHER = "\ue000", "\ue001", "\ue002"
_MARKED = f"{_START}$1$0$11{_NEXT}$2$4$6$8$10{_NEXT}$3$5$7$9{_NEXT}"


def scale_multiplier(scale: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(scale))), F.lit(1.0))


def score_context(context: Column) -> Column:
    return F.when(contains_any(context, REALISTIC), 5).otherwise(0) - F.when(
        contains_any(context, HYPOTHETICAL), 5
    ).otherwise(0)


def amounts(s: Column) -> Column:
    """Amounts of a normalised text in order: array of (score, value).

    One scan marks every match with its context, number and scale; the marked
    text is then cut at the marks.
    """
    clean = F.replace(F.replace(s, F.lit(_START), F.lit(_OTHER)), F.lit(_NEXT), F.lit(_OTHER))
    marked = F.split(F.regexp_replace(clean, AMOUNT, _MARKED), _START)

    def candidate(piece: Column) -> Column:
        def parts(x: Column) -> Column:
            value = F.replace(x[1], F.lit(","), F.lit("")).try_cast("double")
            return F.struct(
                score_context(x[0]).alias("score"), (value * scale_multiplier(x[2])).alias("value")
            )

        return let(F.split(piece, _NEXT), parts)

    return F.transform(let(marked, lambda m: F.slice(m, F.lit(2), F.size(m))), candidate)


def choose_amount(candidates: Column, text: Column) -> Column:
    """Best-scored amount, the last of equals; without a good score the largest,
    or the last when the text hedges."""

    def pick(cands: Column) -> Column:
        best = F.array_max(F.transform(cands, lambda x: x["score"]))
        hedged = contains_any(text, [r"\bdepends\b", r"\bif i were\b"])
        return (
            F.when(F.size(cands) == 0, None)
            .when(
                best > 0,
                F.element_at(F.filter(cands, lambda x: x["score"] == best), -1)["value"],
            )
            .when(hedged, F.element_at(cands, -1)["value"])
            .otherwise(F.array_max(F.transform(cands, lambda x: x["value"])))
        )

    return let(candidates, pick)


def parse_money(c: Column, strict_zero: bool = False) -> Column:
    """Amount named in a text, or NULL."""

    def parse(s: Column) -> Column:
        return (
            F.when(s.isin(NO_ANSWER), None)
            .when(looks_zero(s, strict_zero), 0.0)
            .when(s.rlike("[0-9]"), choose_amount(amounts(s), s))
        )

    # the no-answer words hold no digits, so collapsing first does not change that test
    return F.when(c.isNotNull(), let(collapse_spaced_thousands(normalize_text(c)), parse))


def bound_money(x: Column, cap: float = PAYMENT_CAP) -> Column:
    """Negatives to zero, the rest at most ``cap``; NULL stays NULL."""
    # bound once: x may be a whole parse
    return let(x, lambda v: F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(float(cap)))))
