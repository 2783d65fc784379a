"""Operator 12: quality rules as weak supervision: votes, accuracies by expectation-maximisation, a posterior."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 3
# places in a text that a window's number can tell apart
PLACE_BITS = 20
ROUNDS = 20
# Each rule votes for a text (first condition), against it (second), or abstains. Conditions read the measures
# below and are plain SQL. Beginning and limits of the accuracies follow.
RULES = {
    "word_length": ("word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    "symbols": ("100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "lines": ("n_lines >= 3 AND n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    "windows": ("20 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    "letters": ("10 * n_letters >= 9 * word_chars", "4 * n_letters < 3 * word_chars"),
    "capitals": ("10 * n_capitals <= n_letters", "10 * n_capitals > 3 * n_letters"),
    "sentences": ("n_words BETWEEN 4 * n_ends AND 60 * n_ends", "n_words < 2 * n_ends OR n_words > 150 * n_ends"),
    "line_ends": ("10 * n_ended_lines >= 9 * n_lines", "2 * n_ended_lines < n_lines"),
    "vocabulary": ("n_distinct * n_distinct >= 25 * n_words OR n_words < 100 AND 2 * n_distinct >= n_words",
                   "n_distinct * n_distinct < 9 * n_words"),
}
VOTES, GOOD, BAD = (-1, 0, 1), (0.1, 0.2, 0.7), (0.5, 0.25, 0.25)
STRENGTH, LEAST, MOST, PRIOR = 10.0, 0.001, 0.999, 0.75
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_letters",
    "n_capitals", "n_ends", "n_distinct",
]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in windows of ``width`` words found twice or more in the same text.

    A window is one number, the high bits of its hash with its place below, so that
    sorting puts equal windows side by side: n log n steps for a text of n words. The
    words of neighbours are then compared; where hashes agree and words do not, or a
    text has more places than numbers, the windows themselves are sorted.
    """
    mask = (1 << PLACE_BITS) - 1

    def key(w, i):
        h = F.xxhash64(w, *[F.get(words, i + j) for j in range(1, width)])
        return h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))

    def alike(x, y):
        return F.coalesce(F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0, F.lit(False))

    def at(x):
        return x.bitwiseAND(F.lit(mask)).cast("int")

    def differ(x, y):
        other = ~F.get(words, at(x)).eqNullSafe(F.get(words, at(y)))
        for i in range(1, width):
            other = other | ~F.get(words, at(x) + i).eqNullSafe(F.get(words, at(y) + i))
        return other

    def checked(ts):
        clash = F.transform(ts, lambda x, k: alike(x, F.get(ts, k - 1)) & differ(x, F.get(ts, k - 1)))
        plain = let(F.sort_array(F.transform(ts, lambda x: at(x))), lambda ps: _covered(ps, width))
        return F.when(F.size(ts) == 0, 0).when(F.exists(clash, lambda c: c), _by_windows(words, width)).otherwise(plain)

    def twins(ks):
        return let(F.filter(ks, lambda x, k: alike(x, F.get(ks, k - 1)) | alike(x, F.get(ks, k + 1))), checked)

    keys = F.sort_array(F.slice(F.transform(words, key), 1, F.size(words) - (width - 1)))
    fits = F.size(words) <= mask
    return F.when(F.size(words) < width, 0).when(fits, let(keys, twins)).otherwise(_by_windows(words, width))


def _covered(places: Column, width: int) -> Column:
    gap = F.transform(places, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(places, k + 1) - p, F.lit(width))))
    return F.aggregate(gap, F.lit(0), lambda a, b: a + b)


def _by_windows(words: Column, width: int) -> Column:
    """The same by sorting the windows' words themselves."""

    def window(i):
        return F.struct(F.slice(words, i + 1, width).alias("w"), i.alias("at"))

    def places(ws):
        equal = lambda x, k: F.coalesce(x["w"] == F.get(ws, k)["w"], F.lit(False))
        twice = F.filter(ws, lambda x, k: equal(x, k - 1) | equal(x, k + 1))
        return let(F.sort_array(F.transform(twice, lambda x: x["at"])), lambda ps: _covered(ps, width))

    return let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - width), window)), places)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and MEASURES of every whole text (long), null counted as no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda p: F.regexp_count(text, F.lit(p))
    by_words = lambda w: F.struct(
        F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), repeated_words(w).alias("n_repeat_words"),
        F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x)).alias("word_chars"),
    )
    by_lines = lambda ls: F.struct(
        F.size(ls).alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"),
        F.size(F.filter(ls, lambda x: x.rlike(r"[.!?][\x20\x09-\x0D]*$"))).alias("n_ended_lines"),
    )
    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), by_words)
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), by_lines)
    out = docs.select(
        F.col(id_col).alias("doc_id"), words.alias("w"), lines.alias("l"), count(SYMBOL).alias("n_symbols"),
        count(r"\p{L}").alias("n_letters"), count(r"\p{Lu}").alias("n_capitals"),
        count(r"[.!?]([\x20\x09-\x0D]|$)").alias("n_ends"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_letters", "n_capitals", "n_ends")
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in MEASURES])


def votes(rules=RULES) -> dict[str, Column]:
    """1, -1 or 0 of each rule; a text without words gets no vote."""
    case = "CASE WHEN n_words = 0 THEN 0 WHEN {1} THEN -1 WHEN {0} THEN 1 ELSE 0 END"
    return {k: F.expr(case.format(*r)).cast("int") for k, r in rules.items()}


class Model:
    """Prior share of good texts and, for each rule, how often it votes -1, 0 and 1 on good and on bad texts."""

    def __init__(self, prior: float, good: dict[str, tuple], bad: dict[str, tuple]):
        self.prior, self.good, self.bad = prior, good, bad

    def posterior(self) -> Column:
        """Probability of a good text from the columns of the votes."""
        logs = [math.log(x / y) for k, g in self.good.items() for x, y in zip(g, self.bad[k])]
        # one array value, so that the compiled code is the same for all numbers
        values = F.array(*[F.lit(x) for x in (*logs, math.log(self.prior / (1 - self.prior)))])
        odds = F.get(values, F.lit(len(logs)))
        for i, k in enumerate(self.good):
            odds = odds + F.get(values, F.lit(len(VOTES) * i + 1) + F.col(k))
        return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame, rules=RULES, rounds: int = ROUNDS) -> Model:
    """Accuracies of the rules from their agreement alone, over all rows of ``voted``.

    Abstaining tells something too, so it is an outcome like the votes. Rows are
    counted once per combination of votes, of which there are 3^rules at most
    (19,683); every round is an aggregation over this table. Estimates begin at
    GOOD and BAD and are drawn to them by STRENGTH rows' weight.
    """
    names = list(rules)
    table = written(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "quality-votes")
    model = Model(PRIOR, dict.fromkeys(names, GOOD), dict.fromkeys(names, BAD))
    bounded = lambda x: min(MOST, max(LEAST, x))
    for _ in range(rounds):
        p = model.posterior()
        t = table.select(*names, (F.col("n") * p).alias("g"), (F.col("n") * (1 - p)).alias("b"))
        sums = [F.sum(c).alias(f"_{c}") for c in "gb"]
        sums += [F.sum(F.when(F.col(k) == v, F.col(c))).alias(f"{k}{c}{v}") for c in "gb" for k in names for v in VOTES]
        r = {k: v or 0.0 for k, v in t.agg(*sums).first().asDict().items()}
        share = lambda yes, all_, start: bounded((yes + start * STRENGTH) / (all_ + STRENGTH))
        good, bad = (
            {k: tuple(share(r[f"{k}{c}{v}"], r[f"_{c}"], x) for v, x in zip(VOTES, start)) for k in names}
            for c, start in (("g", GOOD), ("b", BAD))
        )
        model = Model(share(r["_g"], r["_g"] + r["_b"], PRIOR), good, bad)
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, least: float = 0.5) -> DataFrame:
    """One row per document: measures, base_failed, the votes, ``quality`` (posterior, 6 decimals) and kept.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated
    windows. Others are kept if ``quality`` reaches ``least``; the accuracies are fitted
    over all of these others, as texts that fail anyway would be taken for the bad ones.

    Null or empty text: no words, so base_failed, not kept, quality 0. Rows of equal
    ids, null ids and equal texts are judged each for itself. No rows: none. Very
    long texts are measured whole. Other columns of ``docs`` play no part.
    """
    voted = measured(docs, id_col, text_col)
    voted = written(voted.select("*", *[c.alias(k) for k, c in votes(rules).items()]), "quality-measures")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    model = fit(voted.where(~failed), rules)
    p = F.when(F.col("n_words") > 0, F.round(model.posterior(), 6)).otherwise(F.lit(0.0))
    out = voted.withColumn("quality", p).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]


def _sql() -> str:
    names = list(RULES)
    cast = ", ".join(
        f"(CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END) AS {k}" for k, (good, bad) in RULES.items()
    )
    part = {-1: "l", 0: "z", 1: "m"}
    odds = "ln(prior / (1 - prior))" + "".join(
        f" + CASE {k} " + " ".join(f"WHEN {v} THEN ln(g{c}_{k} / b{c}_{k})" for v, c in part.items()) + " END" for k in names
    )
    share = lambda yes, all_, x: (
        f"least({MOST}::DOUBLE, greatest({LEAST}::DOUBLE, ({yes} + {x * STRENGTH}::DOUBLE) / ({all_} + {STRENGTH}::DOUBLE)))"
    )
    each = [(k, c, v, n, x) for k in names for c, first in (("g", GOOD), ("b", BAD)) for (v, n), x in zip(part.items(), first)]
    step = ", ".join(share(f"coalesce(sum({c}) FILTER ({k} = {v}), 0)", f"sum({c})", x) for k, c, v, n, x in each)
    start = ", ".join(f"{x}::DOUBLE" for *_, x in each)
    columns = ", ".join(f"{c}{n}_{k}" for k, c, v, n, _ in each)
    return rf"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM documents),
x AS (SELECT rid, unnest(range(1, len(w) - 1)) AS pos, w FROM d WHERE len(w) >= 3),
y AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, w[pos], w[pos + 1], w[pos + 2]) AS times FROM x),
r AS (SELECT rid, sum(least(3, after)) AS n_repeat_words FROM (
        SELECT rid, coalesce(lead(pos) OVER (PARTITION BY rid ORDER BY pos) - pos, 3) AS after FROM y WHERE times > 1) GROUP BY rid),
m AS (SELECT rid, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '{SYMBOL}'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
             len(list_filter(ls, lambda x: regexp_matches(x, '[.!?][\x20\x09-\x0D]*$')))::BIGINT AS n_ended_lines,
             len(regexp_extract_all(text, '\p{{L}}'))::BIGINT AS n_letters, len(regexp_extract_all(text, '\p{{Lu}}'))::BIGINT AS n_capitals,
             len(regexp_extract_all(text, '[.!?]([\x20\x09-\x0D]|$)'))::BIGINT AS n_ends, len(list_distinct(w))::BIGINT AS n_distinct
      FROM d LEFT JOIN r USING (rid)),
v AS (SELECT *, {cast}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
t AS (SELECT {", ".join(names)}, count(*)::DOUBLE AS n FROM v WHERE NOT base_failed GROUP BY ALL),
em(it, prior, {columns}) AS (
      SELECT 0, {PRIOR}::DOUBLE, {start}
      UNION ALL
      SELECT it + 1, {share("sum(g)", "(sum(g) + sum(b))", PRIOR)}, {step}
      FROM (SELECT it, {", ".join(names)}, n / (1 + exp(-({odds}))) AS g, n - n / (1 + exp(-({odds}))) AS b FROM em, t WHERE it < {ROUNDS}) GROUP BY it),
e AS (SELECT v.*, CASE WHEN n_words > 0 THEN round(1 / (1 + exp(-({odds}))), 6) ELSE 0 END AS quality
      FROM v, em WHERE it = {ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND quality >= 0.5 AS kept, quality FROM e
"""


SQL = _sql()
