"""Repeated runs of consecutive units (lines, sentences), found over a whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import every, fresh, text_hash


def later_runs(units: DataFrame, length: int, min_words: int = 0) -> DataFrame:
    """Starts of all runs that are not the first of their kind: (doc, h, starts).

    ``units`` has doc, h (hash of the text) and hs, an array of structs (a, b:
    two 64-bit hashes of a unit; words: its words). The first of equal runs is
    the one with the smallest (doc, h, position), null before all. A run without
    a word, or with fewer than ``min_words``, counts as no run.
    """
    hs, n = F.col("hs"), F.col("n")
    runs = units.select("doc", "h", "hs", F.size("hs").alias("n")).where(n >= length)
    shifted = [F.slice(hs, i + 1, n) for i in range(length)]
    zipped = F.arrays_zip(*[s.alias(f"s{i}") for i, s in enumerate(shifted)])
    runs = runs.select("doc", "h", "n", F.posexplode(zipped).alias("pos", "z")).where(F.col("pos") <= n - length)
    part = lambda f: [F.col("z").getField(f"s{i}").getField(f) for i in range(length)]
    words = sum(part("words")[1:], part("words")[0])
    runs = runs.where(words >= max(1, min_words)).select(
        "doc", "h", "pos", F.xxhash64(*part("a")).alias("a"), F.xxhash64(*part("b")).alias("b")
    )
    place = F.struct("doc", "h", "pos")
    again = (
        runs.groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        .where("n > 1")
        .drop("n")
    )
    # partial sums per task keep the sets of a document small before they meet
    return (
        runs.join(again, ["a", "b"])
        .where(~place.eqNullSafe(F.col("first")))
        .groupBy("doc", "h")
        .agg(F.collect_set("pos").alias("starts"))
    )


def without_runs(
    docs: DataFrame, id_col: str, text_col: str, parts, glue: str, length: int, min_words: int = 0,
    unit=lambda x: F.trim(x), count: str = "n_units", removed: str = "n_removed", spans: str | None = None,
) -> DataFrame:
    """All rows and columns of ``docs``; the text without the units that later runs cover.

    ``parts`` cuts a text column into an array of units, ``glue`` joins them
    again. Adds ``count`` (units of the text), ``removed`` and, if named,
    ``spans`` (covered positions); columns of ``docs`` of these names are
    replaced. A null text stays null and has 0 units.
    """
    new_names = {c.lower() for c in (count, removed, spans) if c}
    words = lambda x: F.length(x) - F.length(F.translate(x, " ", "")) + 1
    hashed = F.transform(
        parts(F.col("_t")),
        lambda x: F.struct(
            F.xxhash64(unit(x)).alias("a"), F.xxhash64(F.lit(7), unit(x)).alias("b"),
            (words(unit(x)) if min_words else (F.length(unit(x)) > 0).cast("int")).alias("words"),
        ),
    )
    slim = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_t")).where("_t is not null")
    units = slim.select("doc", text_hash(F.col("_t")).alias("h"), hashed.alias("hs"))
    starts = later_runs(units, length, min_words)
    k_doc, k_h, k_starts, own, arr, covered = (fresh(docs, s) for s in ("_doc", "_h", "_starts", "_own", "_units", "_covered"))
    keyed = docs.withColumn(own, text_hash(F.col(text_col)))
    starts = starts.select(F.col("doc").alias(k_doc), F.col("h").alias(k_h), F.col("starts").alias(k_starts))
    joined = keyed.join(
        starts, every([keyed[id_col].eqNullSafe(starts[k_doc]), keyed[own].eqNullSafe(starts[k_h])]), "left"
    )
    cut = joined.withColumn(arr, parts(F.coalesce(F.col(text_col), F.lit("")))).withColumn(
        covered,
        F.array_sort(F.array_distinct(F.flatten(F.transform(k_starts, lambda p: F.sequence(p, p + (length - 1)))))),
    )
    hit, total = F.col(k_starts).isNotNull(), F.size(arr)
    left = F.array_except(F.sequence(F.lit(0), total - 1), F.col(covered))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col(arr), i)), glue)
    new = F.when(hit, kept).otherwise(F.col(text_col))
    out = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c.lower() not in new_names]
    extra = [
        F.when(F.col(text_col).isNull(), 0).otherwise(total).cast("long").alias(count),
        F.when(hit, F.size(covered)).otherwise(0).cast("long").alias(removed),
    ]
    if spans:
        extra.append(F.when(hit, F.col(covered)).otherwise(F.array().cast("array<int>")).alias(spans))
    return cut.select(*out, *extra)
