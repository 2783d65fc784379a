"""Folds and hold-out splits by hash order.

The pseudo-random order is md5(seed:id): the same on every run, however the
rows are partitioned. Positions in that order are exact. A class may hold a
third of all rows, so it is never one window group: the leading digits of the
hash cut it into buckets, each bucket is numbered by itself, and the row counts
of the buckets before it are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.session import materialise

# 16^3 buckets per class; ids are expected to be unique, so buckets are even.
HASH_DIGITS = 3
# A key with more than this share of the rows is handled apart in group splits.
HOT_SHARE = 1.0 / 256


def hash_order(seed, *ids: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def hash_rank(
    df: DataFrame,
    by: Sequence[str],
    seed,
    id_col: str,
    digits: int = HASH_DIGITS,
    appearance: bool = True,
) -> DataFrame:
    """Positions in hash order, as columns added to the rows.

    ``_rank``   position within the ``by`` group, from 1
    ``_total``  rows of the group
    ``_place``  position over all rows, from 0, group after group; groups come
                by their smallest id (``appearance``) or by their key

    The rows are shuffled and sorted once, by group and bucket. The bucket
    table it is joined with has at most 16^digits rows per group.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    # NULL is a group of its own
    keyed = df.select(
        "*",
        *[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(k) for c, k in zip(by, keys)],
        hash_order(seed, F.col(id_col)).alias("_h"),
    ).withColumn("_b", F.substring("_h", 1, digits))
    group, everything = Window.partitionBy(*keys), Window.partitionBy()
    so_far = (Window.unboundedPreceding, 0)
    buckets = (
        keyed.groupBy(*keys, "_b")
        .agg(F.count("*").alias("_n"), F.min(id_col).alias("_min"))
        .withColumn("_first", F.min("_min").over(group))
        .select(
            *keys,
            "_b",
            (F.sum("_n").over(group.orderBy("_b").rowsBetween(*so_far)) - F.col("_n")).alias("_off"),
            F.sum("_n").over(group).alias("_total"),
            # one partition, but of bucket counts only
            (
                F.sum("_n").over(
                    everything.orderBy(*(["_first"] if appearance else []), *keys, "_b").rowsBetween(*so_far)
                )
                - F.col("_n")
            ).alias("_start"),
        )
    )
    numbered = keyed.withColumn(
        "_i", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", id_col))
    )
    return numbered.join(buckets, [*keys, "_b"]).select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("_off") + F.col("_i")).alias("_rank"),
        "_total",
        (F.col("_start") + F.col("_i") - 1).alias("_place"),
    )


def stratified_kfold(
    df: DataFrame,
    label: str,
    id_col: str,
    n_splits: int = 5,
    seed=42,
    out: str = "fold",
    appearance: bool = True,
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Fold number 0..n-1 per row, each class spread evenly.

    Fold sizes are those of dealing the class-sorted rows out in turn: a class
    goes on where the class before it stopped. Classes come in order of
    appearance (smallest id first) or, if not ``appearance``, of their value.
    """
    ranked = hash_rank(df, [label], seed, id_col, digits, appearance)
    return ranked.withColumn(out, F.pmod("_place", F.lit(n_splits)).cast("int")).drop(
        "_rank", "_total", "_place"
    )


def stratified_group_kfold(
    df: DataFrame,
    label: str,
    group_col: str,
    n_splits: int = 5,
    seed=42,
    out: str = "fold",
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Like :func:`stratified_kfold`, but the rows of one group share a fold.

    Groups are dealt out by their most frequent class, so that every fold gets
    about as many groups of each class.
    """
    groups = (
        df.groupBy(group_col, label)
        .agg(F.count("*").alias("_n"))
        .groupBy(group_col)
        .agg(
            F.max_by(label, F.struct(F.col("_n"), F.col(label))).alias("_major"),
            F.sum("_n").alias("_rows"),
        )
    )
    # one row per group, read several times: written, so that the rows are aggregated once
    groups = materialise(groups, "groups")
    folds = stratified_kfold(groups, "_major", group_col, n_splits, seed, out, False, digits)
    return attach_by_key(df, materialise(folds, "group-folds"), group_col, out, "_rows")


def balanced_group_kfold(
    df: DataFrame, label: str, group_col: str, n_splits: int = 5, seed=42, out: str = "fold", bundles: int = 64
) -> DataFrame:
    """Folds of like size and like classes whose rows keep each group together.

    Groups with more than 1 / (n_splits * bundles) of the rows, of which there are
    fewer than that many, are placed one by one; all others are dealt by hash into
    n_splits * bundles bundles, placed whole. The largest come first, and each goes
    to the fold where its classes are rarest so far, counted in shares of the class
    and of all rows. Only class counts of groups and bundles reach the driver.

    A null group is a group, a null label a class. No rows: none.
    """
    units = n_splits * bundles
    sizes = df.groupBy(group_col, label).agg(F.count("*").alias("_n"))
    per = sizes.groupBy(group_col).agg(
        F.sum("_n").alias("_rows"), F.map_from_entries(F.collect_list(F.struct(_named(label).alias("k"), "_n"))).alias("_by")
    )
    groups = materialise(per.withColumn("_of", F.conv(F.substring(hash_order(seed, F.coalesce(F.col(group_col).cast("string"), F.lit("\0"))), 1, 8), 16, 10).cast("long") % units), "groups")
    total = groups.agg(F.sum("_rows")).first()[0] or 0
    unit = F.when(F.col("_rows") * units > total, F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-")))
    groups = groups.withColumn("_unit", F.coalesce(unit, F.col("_of").cast("string")))
    counts = groups.select("_unit", F.explode("_by").alias("_class", "_n")).groupBy("_unit", "_class").agg(F.sum("_n").alias("_n"))
    placed = _placed({(r["_unit"], r["_class"]): r["_n"] for r in counts.collect()}, n_splits)
    folds = df.sparkSession.createDataFrame(sorted(placed.items()), f"_unit string, `{out}` int")
    folds = groups.join(F.broadcast(folds), "_unit").select(group_col, out, "_rows")
    return attach_by_key(df, materialise(folds, "group-folds"), group_col, out, "_rows")


def _named(label: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("-"))


def _placed(counts: dict[tuple[str, str], int], n_splits: int) -> dict[str, int]:
    """Fold of each unit from its class counts; whole numbers, so every run and engine agrees."""
    per, of_class = {}, {}
    for (unit, c), n in counts.items():
        per.setdefault(unit, {})[c] = n
        of_class[c] = of_class.get(c, 0) + n
    total = sum(of_class.values())
    weight = {c: 1_000_000 * total * total // (n * n) for c, n in of_class.items()}
    folds, rows, out = [dict.fromkeys(of_class, 0) for _ in range(n_splits)], [0] * n_splits, {}
    for unit in sorted(per, key=lambda u: (-sum(per[u].values()), u)):
        mine = per[unit]
        size = sum(mine.values())
        cost = [sum(weight[c] * n * f[c] for c, n in mine.items()) + 1_000_000 * len(of_class) * size * r for f, r in zip(folds, rows)]
        best = cost.index(min(cost))
        out[unit] = best
        rows[best] += size
        for c, n in mine.items():
            folds[best][c] += n
    return out


def attach_by_key(df: DataFrame, table: DataFrame, key: str, value: str, rows: str) -> DataFrame:
    """Left join of one value per key that survives a hot key.

    ``table`` has one row per key, with the number of its rows in ``df``. Keys
    above the hot share are fewer than 1/HOT_SHARE by that definition; their rows
    meet them as a broadcast and never move. All other rows are joined by key.
    """
    limit = max(1.0, (table.agg(F.sum(rows)).first()[0] or 0) * HOT_SHARE)
    mine = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.col(rows).alias("_n"))
    hot, cold = F.broadcast(mine.filter(F.col("_n") > limit)), mine.filter(F.col("_n") <= limit)
    here = F.col(key).eqNullSafe(F.col("_k"))
    names = [*[F.col(f"`{c}`") for c in df.columns], F.col("_v").alias(value)]
    others = df.join(hot, here, "left_anti")
    return df.join(hot, here).select(*names).unionByName(others.join(cold, here, "left").select(*names))


def holdout(
    df: DataFrame,
    label: str | None,
    id_col: str,
    train_size: float = 0.8,
    seed=42,
    stratify: bool = True,
    out: str = "is_train",
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Mark an exact share of the rows, per class or over all, as training rows.

    Per class, a class of two or more rows keeps at least one row on each side.
    """
    ranked = hash_rank(df, [label] if stratify else [], seed, id_col, digits)
    n = F.bround(F.col("_total") * F.lit(float(train_size)), 0)
    if stratify:
        both = F.greatest(F.lit(1.0), F.least(F.col("_total") - F.lit(1.0), n))
        n = F.when(F.col("_total") >= 2, both).otherwise(n)
    return ranked.withColumn(out, F.col("_rank") <= n).drop("_rank", "_total", "_place")
