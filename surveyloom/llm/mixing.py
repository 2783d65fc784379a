"""Operator 9: mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import fresh, numbered, running_total, written

WORD = r"[^\x20\x09-\x0D]+"
# 2^32 over the golden ratio: multiples of it modulo 2^32 are the golden-ratio points
GOLDEN = 2654435769
ROWS_PER_BUCKET = 512


def sized(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(doc_id, source, size): words of each whole text, null text 0."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2, block: int = 4096) -> DataFrame:
    """One row per source: no, source_size, target, goal, slots, and its part [lo, hi) of the slots.

    Sources by code point, null last, get the weights in turn. Targets are in
    proportion to the weights, add up to ``share`` of all sizes, and stop at
    ``cap`` times the source; what is cut off goes to the others by weight. Sources
    in the order of cap / weight stop one after the other, so the level that the
    others reach follows from sums along that order. ``goal`` is the target in whole
    words, ``slots`` the blocks it takes: whole passes, and the last cut to its words.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = numbered(per, [F.col("source").asc_nulls_last()], "no", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    src = src.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    size, w_all = src.agg(F.sum("source_size"), F.sum("weight")).first()
    total = min(share, cap) * (size or 0)
    by = numbered(src, [F.col("cap") / F.col("weight"), F.col("no")], "place", "mix-order")
    by = by.withColumn("chunk", F.floor(F.col("place") / ROWS_PER_BUCKET))
    by = running_total(by, [], "chunk", ["place"], "cap", "capped")
    by = running_total(by, [], "chunk", ["place"], "weight", "gone")
    # the level if all sources before this one stop and this one does not
    level = (F.lit(total) - F.col("capped")) / (F.lit(w_all or 1) - F.col("gone"))
    reached = by.withColumn("level", level).where(F.col("cap") / F.col("weight") > F.col("level"))
    first = reached.agg(F.min_by("level", "place")).first()[0]
    target = F.col("cap") if first is None else F.least("cap", F.lit(first) * F.col("weight"))
    src = src.withColumn("target", target)
    src = src.withColumn("goal", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * cap).cast("long"))
    whole = F.floor(F.col("goal") / F.greatest("source_size", F.lit(1))) * F.ceil(F.col("source_size") / block)
    rest = F.ceil(F.pmod("goal", F.greatest("source_size", F.lit(1))) / block)
    src = src.withColumn("slots", (whole + rest).cast("long")).withColumn("chunk", F.floor(F.col("no") / ROWS_PER_BUCKET))
    src = running_total(src, [], "chunk", ["no"], "slots", "lo")
    return written(src.select("source", "no", "source_size", "target", "goal", "slots", "lo", (F.col("lo") + F.col("slots")).alias("hi")), "mix-targets")


def schedule(targets: DataFrame) -> DataFrame:
    """(slot, no, rank): one slot for every block that a source takes, ``rank`` counting those of its source.

    There are as many points as slots, and each source's part of the scale is as
    long as its slots are many. Slot j takes the point j times the golden ratio
    (modulo 1), so every stretch of the schedule holds the sources in their shares.
    A source's points may miss its number by a few: those over are left out, and what
    is missing follows at the end, source by source.
    """
    spark = targets.sparkSession
    n, n_src = targets.agg(F.sum("slots"), F.count(F.lit(1))).first()
    n = n or 0
    point = F.floor(F.pmod(F.col("id") * GOLDEN, F.lit(1 << 32)) * F.lit(float(n)) / F.lit(float(1 << 32)))
    points = spark.range(n).select(F.col("id").alias("slot"), point.cast("long").alias("point"))
    # a grid of as many cells as sources: a cell meets two sources on average
    cell = lambda c: F.floor(c * n_src / F.lit(n or 1))
    spans = targets.where("hi > lo").select(
        "no", "slots", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell")
    )
    hit = (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))
    placed = points.withColumn("cell", cell(F.col("point"))).join(spans, "cell").where(hit).select("slot", "no", "slots")
    placed = placed.withColumn("one", F.lit(1)).withColumn("chunk", F.floor(F.col("slot") / ROWS_PER_BUCKET))
    placed = running_total(placed, ["no"], "chunk", ["slot"], "one", "rank").where("rank < slots").select("slot", "no", "rank")
    placed = written(placed, "mix-slots")
    had = placed.groupBy("no").agg(F.count(F.lit(1)).alias("had"))
    more = targets.select("no", "slots").join(had, "no", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    more = more.where("had < slots").withColumn("missing", F.col("slots") - F.col("had"))
    more = more.withColumn("chunk", F.floor(F.col("no") / ROWS_PER_BUCKET))
    more = running_total(more, [], "chunk", ["no"], "missing", "before")
    tail = more.select("no", "had", "before", F.explode(F.sequence(F.col("had"), F.col("slots") - 1)).alias("rank"))
    tail = tail.select((F.lit(n) + F.col("before") + F.col("rank") - F.col("had")).alias("slot"), "no", "rank")
    return placed.unionByName(tail)


def mix(
    docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(3, 1, 2),
    share: float = 1.5, cap: int = 2, block: int = 4096, seed: str = "mix",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, first_slot.

    The words of a source form one stream: its documents in the order of
    md5(seed:id). The stream is cut into blocks of ``block`` words; the r-th slot
    that the schedule gives to the source takes block r, from the first again after
    the last, and its last slot takes only the words that its target still needs, so
    every source's words meet its target to the word, however small it is.
    ``taken`` counts a document's words in all blocks taken, so it is at most
    ``cap`` times its size; ``first_slot`` is the slot that takes its first ones.

    Null text: size 0, nothing taken, first_slot null. Null source: a source of its
    own, the last. Null ids are ordinary ids. Rows that agree in id and size are laid
    one after the other. No rows: none. Other columns of ``docs`` play no part.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = written(sized(docs, id_col, text_col, source_col).withColumn("hash", order), "mix-sizes")
    targets = source_targets(docs, weights, share, cap, block)
    buckets = max(1, math.ceil(docs.count() / ROWS_PER_BUCKET))
    place = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * buckets
    t = targets.select(F.col("source").alias("_s"), "no", "source_size", "target")
    rows = docs.join(t, docs["source"].eqNullSafe(t["_s"])).drop("_s")
    rows = rows.withColumn("bucket", F.shiftright(place, 32))
    nothing = F.lit(None).cast("long").alias("first_slot")
    none = rows.where("size = 0").select(
        "doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), nothing
    )
    laid = running_total(rows.where("size > 0"), ["no"], "bucket", ["hash", "doc_id", "size"], "size", "at")
    # a slot's stretch of the stream: a whole block, or what the last one still needs
    slots = schedule(targets).join(targets.select("no", "source_size", "goal", "slots"), "no")
    per_pass = F.ceil(F.col("source_size") / block)
    slots = slots.withColumn("block", F.pmod("rank", per_pass))
    left = F.col("goal") - F.floor(F.col("rank") / per_pass) * F.col("source_size") - F.col("block") * block
    slots = slots.select("no", "block", "slot", F.least(F.lit(block), left).alias("words"))
    drawn = slots.groupBy("no", "block").agg(F.collect_list(F.struct("slot", "words")).alias("draws"))  # cap + 1 at most
    end = F.col("at") + F.col("size")
    pieces = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block))))
    lo = F.greatest(F.col("at") - F.col("block") * block, F.lit(0))
    hi = F.least(end - F.col("block") * block, F.lit(block))
    pieces = pieces.join(drawn, ["no", "block"], "left")
    met = F.filter("draws", lambda d: d["words"] > lo)
    words = F.aggregate(met, F.lit(0).cast("long"), lambda n, d: n + F.least(d["words"], hi) - lo)
    pieces = pieces.withColumn("words", F.coalesce(words, F.lit(0))).withColumn("slot", F.array_min(F.transform(met, lambda d: d["slot"])))
    taken = pieces.groupBy("no", "at", "doc_id", "source", "size", "source_size", "target").agg(
        F.sum("words").alias("taken"), F.min("slot").alias("first_slot")
    )
    return taken.drop("no", "at").unionByName(none)


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` as often as the mix takes it: taken words over words, rounded half up.

    Rows of one id go as often as their words together say. Columns stay as they are.
    """
    n, key = fresh(docs, "_times"), fresh(docs, "_id")
    times = mixed.groupBy(F.col("doc_id").alias(key)).agg(
        F.floor(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1)) + 0.5).cast("int").alias(n)
    )
    out = docs.join(times.where(F.col(n) > 0), docs[id_col].eqNullSafe(times[key]))
    again = fresh(docs, "_again")
    out = out.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(n))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS hash FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
      FROM s GROUP BY source),
w AS (SELECT *, [3, 1, 2][(no % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM g),
a AS (SELECT 1.5::DOUBLE * sum(source_size) AS total FROM g),
o AS (SELECT cap / weight AS ratio, sum(cap) OVER r AS capped, (SELECT sum(weight) FROM w) - sum(weight) OVER r AS rest,
             row_number() OVER (ORDER BY cap / weight, no) AS k FROM w
      WINDOW r AS (ORDER BY cap / weight, no ROWS UNBOUNDED PRECEDING)),
c AS (SELECT k, (total - capped) / rest AS lam FROM o, a WHERE rest > 0
      UNION ALL SELECT 0, total / (SELECT sum(weight) FROM w) FROM a),
lam AS (SELECT lam FROM c LEFT JOIN o ON o.k = c.k + 1 WHERE o.ratio IS NULL OR o.ratio > lam ORDER BY c.k LIMIT 1),
t AS (SELECT w.*, CASE WHEN (SELECT count(*) FROM lam) = 0 THEN cap ELSE least(cap, (SELECT lam FROM lam) * weight) END AS target
      FROM w),
p AS (SELECT *, least(floor(target + 0.5), 2 * source_size)::BIGINT AS goal FROM t),
q AS (SELECT *, (goal // source_size * ceil(source_size / 4096) + ceil(goal % source_size / 4096))::BIGINT AS slots
      FROM p WHERE source_size > 0),
u AS (SELECT *, sum(slots) OVER (ORDER BY no)::BIGINT AS hi, sum(slots) OVER ()::BIGINT AS n FROM q),
j AS (SELECT slot, floor(((slot * 2654435769) % 4294967296)::DOUBLE * n / 4294967296)::BIGINT AS point
      FROM (SELECT DISTINCT n, unnest(range(0, n)) AS slot FROM u)),
h AS (SELECT no, slot, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS rank
      FROM j JOIN u ON point >= hi - slots AND point < hi QUALIFY rank < max(slots) OVER (PARTITION BY no)),
m AS (SELECT no, unnest(range((SELECT count(*) FROM h WHERE h.no = u.no), slots)) AS rank, n FROM u),
r AS (SELECT no, slot, rank FROM h
      UNION ALL SELECT no, n + row_number() OVER (ORDER BY no, rank) - 1, rank FROM m),
d AS (SELECT r.no, slot, rank % ceil(source_size / 4096)::BIGINT * 4096 AS lo,
             least(4096, goal - rank // ceil(source_size / 4096)::BIGINT * source_size - lo) + lo AS hi FROM r JOIN q USING (no)),
e AS (SELECT s.*, no, source_size, target,
             sum(size) OVER (PARTITION BY no ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS pos,
             row_number() OVER () AS rid
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT e.doc_id, e.size, e.source_size, e.target,
       coalesce(sum(least(pos + size, hi) - greatest(pos, lo)) FILTER (slot IS NOT NULL), 0)::BIGINT AS taken, min(slot) AS first_slot
FROM e LEFT JOIN d ON d.no = e.no AND d.lo < e.pos + e.size AND d.hi > e.pos AND e.size > 0
GROUP BY e.rid, e.doc_id, e.size, e.source_size, e.target
"""
