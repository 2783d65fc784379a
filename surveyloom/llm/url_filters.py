"""Operator 1: URL filters by association rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import fresh, written

# Fixed values: (host, path, verdict) of the given rules.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one, and for null."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def given_rule(h: Column, p: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host_, path_, verdict_ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((h == host_) | h.endswith("." + host_)) & p.startswith(path_)
        rule = F.when(fits, F.lit(host_ + path_)).otherwise(rule)
        verdict = F.when(fits, F.lit(verdict_)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, h: Column, p: Column) -> Column:
    """A sorted set of at most ten tokens: parts of host and path, digits as #.

    Ten kinds of tokens with one value each bound the itemsets of a row, and so
    the rules, whatever the URL looks like.
    """
    labels = F.split(h, r"\.")
    parts = F.filter(F.split(p, "/"), lambda s: s != "")
    shape = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    kinds = {
        "tld": F.when(h != "", F.try_element_at(labels, F.lit(-1))),
        "name": F.try_element_at(labels, F.lit(-2)),
        "sub": F.try_element_at(labels, F.lit(-3)),
        "subsub": F.try_element_at(labels, F.lit(-4)),
        "first": shape(F.get(parts, F.lit(0))),
        "second": shape(F.get(parts, F.lit(1))),
        "file": F.when(F.regexp_extract(p, r"\.([A-Za-z]+)$", 1) != "", F.regexp_extract(p, r"\.([A-Za-z]+)$", 1)),
        "slash": F.when(p.endswith("/"), "yes"),
        "query": F.when(F.instr(url, "?") > 0, F.regexp_extract(url, r"\?([^=&#]*)", 1)),
        "mark": F.when(F.instr(url, "#") > 0, "yes"),
    }
    return F.array_sort(
        F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(k + ":"), c)) for k, c in kinds.items()]))
    )


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """Rules (tokens, verdict, confidence, support) from rows of (tokens, verdict).

    FP-growth counts the token sets of all labelled rows together with their
    verdicts. A rule stays if token set and verdict meet in ``min_support`` of
    the rows and the verdict holds for ``min_confidence`` of the token set's.
    """
    rows = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    if rows.isEmpty():
        empty = "tokens array<string>, verdict string, confidence double, support double"
        return labelled.sparkSession.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    verdict = F.get("consequent", F.lit(0))
    rules = model.associationRules.where(verdict.startswith("="))
    return written(
        rules.select(F.col("antecedent").alias("tokens"), F.substr(verdict, F.lit(2)).alias("verdict"), "confidence", "support"),
        "url-rules",
    )


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The best rule's (verdict, confidence) of each distinct token set that any rule fits.

    An inverted index leads from a token to the rules that name it; a rule fits a
    set that holds as many of its tokens as it has. Best is the highest
    confidence, then support, then more tokens, then block before allow. The
    index has at most 2^10 / min_support rules by construction.
    """
    numbered = rules.select(F.xxhash64("tokens", "verdict").alias("rule"), "*", F.size("tokens").alias("needs"))
    index = numbered.select("rule", F.explode("tokens").alias("token"))
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    held = hits.groupBy("tokens", "rule").agg(F.count(F.lit(1)).alias("held"))
    good = held.join(numbered.drop("tokens"), "rule").where("held = needs")
    best = F.max(F.struct("confidence", "support", "needs", "verdict")).alias("best")
    return good.groupBy("tokens").agg(best).select("tokens", "best.verdict", "best.confidence")


def judge(
    pages: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = tuple(RULES),
    labelled: DataFrame | None = None, min_support: float = 0.01, min_confidence: float = 0.8,
    default: str = "allow",
) -> DataFrame:
    """All rows and columns of ``pages`` with host, path, rule, verdict and origin.

    Given rules come first. Other URLs get the verdict of the best mined rule, and
    ``default`` where none fits; ``origin`` says which (rule, mined, default).
    Rules are mined from ``labelled`` (url, verdict) or, without it, from the rows
    that the given rules judge.

    Null URL, or one without ``://``: empty host and path, no host or path token.
    Equal URLs get equal verdicts. No labelled row: nothing is mined. Columns of
    ``pages`` named like a result are replaced.
    """
    results = ("host", "path", "rule", "verdict", "origin")
    keep = [c for c in pages.columns if c.lower() not in results]
    url, toks, given, key, found, conf = (fresh(pages, s) for s in ("_u", "_tokens", "_given", "_key", "_found", "_conf"))
    text = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], text.alias(url))
    u = F.col(url)
    rows = rows.withColumns({"host": host(u), "path": path(u)})
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, given: verdict, toks: tokens(u, F.col("host"), F.col("path"))})
    if labelled is None:
        source = rows.where(F.col(given).isNotNull()).select(F.col(toks).alias("tokens"), F.col(given).alias("verdict"))
    else:
        source = labelled.where("verdict is not null").select(
            tokens(F.coalesce("url", F.lit("")), host(F.col("url")), path(F.col("url"))).alias("tokens"), "verdict"
        )
    mined = mine(source, min_support, min_confidence)
    sets = rows.where(F.col(given).isNull()).select(F.col(toks).alias("tokens")).distinct()
    # written, so that the join below stands alone and a frequent set can be split
    best = written(match(sets, mined).select(F.col("tokens").alias(key), F.col("verdict").alias(found)), "url-sets")
    out = rows.join(best, rows[toks] == best[key], "left")
    return out.select(
        *[F.col(f"`{c}`") for c in keep], "host", "path", "rule",
        F.coalesce(given, found, F.lit(default)).alias("verdict"),
        F.when(F.col(given).isNotNull(), "rule").when(F.col(found).isNotNull(), "mined").otherwise("default").alias("origin"),
    )


SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url,
                  CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1) AS host_, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
r AS (SELECT page_id, url, path, translate(host_, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM h),
g AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
                     WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
                     WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
                     WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
                     WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule,
             string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda s: s <> '') AS p FROM r),
t AS (SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS given,
             list_sort(list_filter([
               CASE WHEN host <> '' THEN 'tld:' || l[-1] END,
               CASE WHEN len(l) > 1 THEN 'name:' || l[-2] END,
               CASE WHEN len(l) > 2 THEN 'sub:' || l[-3] END,
               CASE WHEN len(l) > 3 THEN 'subsub:' || l[-4] END,
               CASE WHEN len(p) > 0 THEN 'first:' || regexp_replace(p[1], '[0-9]+', '#', 'g') END,
               CASE WHEN len(p) > 1 THEN 'second:' || regexp_replace(p[2], '[0-9]+', '#', 'g') END,
               CASE WHEN regexp_extract(path, '\.([A-Za-z]+)$', 1) <> '' THEN 'file:' || regexp_extract(path, '\.([A-Za-z]+)$', 1) END,
               CASE WHEN suffix(path, '/') THEN 'slash:yes' END,
               CASE WHEN contains(url, '?') THEN 'query:' || regexp_extract(url, '\?([^=&#]*)', 1) END,
               CASE WHEN contains(url, '#') THEN 'mark:yes' END], lambda x: x IS NOT NULL)) AS tokens FROM g),
lab AS (SELECT tokens, given, count(*) AS n FROM t WHERE given IS NOT NULL GROUP BY ALL),
sub AS (SELECT given, n, list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS x
        FROM (SELECT *, unnest(range(1, 1 << len(tokens))) AS m FROM lab)),
cnt AS (SELECT x, sum(n) AS n FROM sub GROUP BY x),
rules AS (SELECT s.x, s.given AS verdict, s.n / c.n AS confidence, s.n AS support, len(s.x) AS needs
          FROM (SELECT x, given, sum(n) AS n FROM sub GROUP BY ALL) s JOIN cnt c ON s.x = c.x
          WHERE s.n >= ceil(0.01 * (SELECT sum(n) FROM lab)) AND s.n / c.n >= 0.8),
best AS (SELECT tokens, arg_max(verdict, (confidence, support, needs, verdict)) AS verdict
         FROM (SELECT DISTINCT tokens FROM t WHERE given IS NULL) JOIN rules ON list_has_all(tokens, x) GROUP BY tokens)
SELECT page_id, host, path, rule, coalesce(given, verdict, 'allow') AS verdict,
       CASE WHEN given IS NOT NULL THEN 'rule' WHEN verdict IS NOT NULL THEN 'mined' ELSE 'default' END AS origin
FROM t LEFT JOIN best USING (tokens)
"""
