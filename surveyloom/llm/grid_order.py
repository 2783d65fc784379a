"""Operator 8: embedding near-dedup by an epsilon grid order join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import by_value, every, written
from surveyloom.llm.components import components
from surveyloom.llm.vectors import matrix, rotation, usable

BLOCK = 1024
LEAF = 128
# leading principal dimensions of the grid
GRID = 6
_BLOCKS = pa.schema(
    [
        ("block", pa.int64()), ("label", pa.string()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
        ("nodes", pa.binary()), ("copies", pa.binary()), ("rows", pa.binary()),
    ]
)
_DDL = "block long, label string, lo array<double>, hi array<double>, nodes binary, copies binary, rows binary"


def _joined(a, b, reach: float, threshold: float):
    """Linked (row of a, row of b) of two sorted sequences, cut in halves until small; distant halves are skipped."""
    found = []

    def go(i: int, j: int, k: int, m: int) -> None:
        g = min(GRID, a.shape[1])
        x, y = a[i:j, :g], b[k:m, :g]
        gap = np.maximum(0, np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)))
        if (gap * gap).sum() > reach * reach or (a is b and m <= i):
            return
        if j - i <= LEAF and m - k <= LEAF:
            r, c = np.nonzero(a[i:j] @ b[k:m].T >= threshold)
            r, c = r + i, c + k
            found.append((r, c) if a is not b else (r[r < c], c[r < c]))
        elif j - i >= m - k:
            h = (i + j) // 2
            go(i, h, k, m)
            go(h, j, k, m)
        else:
            h = (k + m) // 2
            go(i, j, k, h)
            go(i, j, h, m)

    if len(a) and len(b):
        go(0, len(a), 0, len(b))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _roots(n: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches by links (r, c)."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[r], low[c])
        new = low.copy()
        np.minimum.at(new, r, m)
        np.minimum.at(new, c, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def near_vectors(
    vectors: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", threshold: float = 0.93
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null and their cosine, in
    double precision, is at least ``threshold``: for vectors of length 1, if they
    are close enough. Copies of one vector are joined as one row that counts for
    all. The distinct ones are turned to principal directions and sorted by label
    and grid cell; runs of ``BLOCK`` make blocks with a bounding box. Blocks meet
    by grid cells of the two leading directions, widened by the reach, and by the
    distance of their boxes. A task joins two blocks and returns link counts and a
    tree of links for each row, never the pairs. A component is the smallest id
    reached; ``kept`` marks it.

    Vectors that are null, zero or hold a null or non-finite component, and those
    with a null label or id, link with nothing: n_links 0, the own id as component.
    Shorter vectors count as ending in zeros. Rows of one id are one node of the
    graph. No rows: none. Other columns play no part.
    """
    by_value("surveyloom.llm.vectors", __name__)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.col(label_col).cast("string").alias("label"),
    )
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    # very small or large components are scaled first, which no cosine depends on
    most = F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    good = usable(rows, "vector").where("vec_id is not null and label is not null").withColumn("most", most).where("most > 0")
    key = lambda d: d.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(7), "vector")})
    good = key(good).select("vec_id", "label", "h1", "h2", "most", "vector")
    groups = written(
        good.groupBy("label", "h1", "h2").agg(
            F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"),
            F.first(F.transform("vector", lambda x: x / F.col("most"))).alias("vector"),
        ), "ego-vectors",
    )
    unit = groups.withColumn("size", F.sqrt(size)).withColumn("vector", F.transform("vector", lambda x: x / F.col("size")))
    dims = unit.agg(F.max(F.size("vector"))).first()[0]
    if dims:
        sums, comps = _links(unit, dims, threshold)
    else:
        empty = vectors.sparkSession.createDataFrame
        sums, comps = empty([], "node long, links long"), empty([], "node long, component long")
    known = groups.select("label", "h1", "h2", "node", "copies").join(sums, "node", "left").join(comps, "node", "left")
    known = known.select(
        F.col("label").alias("l"), F.col("h1").alias("a"), F.col("h2").alias("b"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("c"),
    )
    joins = F.col("vector").isNotNull() & F.col("label").isNotNull()
    keyed = key(rows.withColumn("label", F.when(joins, F.col("label")))).select("vec_id", "label", "h1", "h2")
    out = keyed.join(known, every([keyed["label"] == known["l"], keyed["h1"] == known["a"], keyed["h2"] == known["b"]]), "left")
    comp = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id"))
    return out.select(
        "vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _links(unit: DataFrame, dims: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) sums and (node, component) of distinct unit vectors."""
    spark = unit.sparkSession
    turn = rotation(unit, "vector", dims)
    grid = min(GRID, dims)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9)

    def turned(batches):
        for b in batches:
            y = matrix(b.column("vector"), dims) @ turn
            cells = np.floor(y[:, :grid] / max(reach, 1e-6)).astype(np.int64)
            yield pa.record_batch(
                [b.column("label"), b.column("node"), b.column("copies"), pa.array(list(cells)), pa.array([r.tobytes() for r in y], pa.binary())],
                names=["label", "node", "copies", "cells", "row"],
            )

    rows = unit.select("label", "node", "copies", "vector").mapInArrow(
        turned, "label string, node long, copies long, cells array<long>, row binary"
    )
    order = ["label", "cells", "node"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches):
        base, n, held = TaskContext.get().partitionId() << 32, 0, []

        def out(part):
            nonlocal n
            y = np.frombuffer(b"".join(part["row"]), np.float64).reshape(-1, dims)
            values = [
                [base + n], [part["label"][0]], [y[:, :grid].min(axis=0)], [y[:, :grid].max(axis=0)],
                [np.array(part["node"], np.int64).tobytes()], [np.array(part["copies"], np.int64).tobytes()], [y.tobytes()],
            ]
            n += 1
            return pa.record_batch([pa.array(v, f.type) for v, f in zip(values, _BLOCKS)], schema=_BLOCKS)

        for b in batches:
            for r in b.to_pylist():
                if held and (held[0]["label"] != r["label"] or len(held) == BLOCK):
                    yield out({k: [h[k] for h in held] for k in r})
                    held = []
                held.append(r)
        if held:
            yield out({k: [h[k] for h in held] for k in held[0]})

    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    packed = written(ranged.mapInArrow(blocks, _DDL), "ego-blocks")
    meta = packed.select("block", "label", "lo", "hi")
    cell = lambda c: F.floor(c / F.lit(reach)).cast("long")
    second = min(1, grid - 1)

    def spread(d: DataFrame, by: float) -> DataFrame:
        low = [cell(F.col("lo")[i] - by) for i in (0, second)]
        high = [cell(F.col("hi")[i] + by) for i in (0, second)]
        d = d.withColumns({"low0": low[0], "low1": low[1]})
        d = d.withColumn("k0", F.explode(F.sequence(low[0], high[0])))
        return d.withColumn("k1", F.explode(F.sequence(low[1], high[1])))

    left = spread(meta, 0.0)
    right = spread(meta, reach).select(*[F.col(c).alias(f"r_{c}") for c in ("block", "label", "lo", "hi", "low0", "low1", "k0", "k1")])
    met = left.join(right, every([left["label"] == right["r_label"], left["k0"] == right["r_k0"], left["k1"] == right["r_k1"]]))
    # blocks that share several cells count in the first of them only
    once = (F.col("k0") == F.greatest("low0", "r_low0")) & (F.col("k1") == F.greatest("low1", "r_low1"))
    gap = lambda a, b: F.greatest(F.lit(0.0), a - b)
    sides = [gap(F.col("lo")[i], F.col("r_hi")[i]) + gap(F.col("r_lo")[i], F.col("hi")[i]) for i in range(grid)]
    near = sum((s * s for s in sides[1:]), sides[0] * sides[0]) <= reach * reach
    pairs = met.where(once & near & (F.col("block") <= F.col("r_block"))).select("block", "r_block")
    data = packed.select("block", "nodes", "copies", "rows")
    other = data.select(*[F.col(c).alias(f"r_{c}") for c in data.columns])
    both = pairs.join(data, "block").join(other, "r_block")

    def link(batches):
        for batch in batches:
            for p in batch.to_pylist():
                a = np.frombuffer(p["rows"]).reshape(-1, dims)
                same = p["block"] == p["r_block"]
                b = a if same else np.frombuffer(p["r_rows"]).reshape(-1, dims)
                node = np.frombuffer(p["nodes"], np.int64)
                many = np.frombuffer(p["copies"], np.int64)
                if not same:
                    node = np.concatenate((node, np.frombuffer(p["r_nodes"], np.int64)))
                    many = np.concatenate((many, np.frombuffer(p["r_copies"], np.int64)))
                r, c = _joined(a, b, reach, threshold)
                c = c if same else c + len(a)
                links = np.bincount(r, many[c], len(node)) + np.bincount(c, many[r], len(node))
                on = np.flatnonzero(links)
                root = node[_roots(len(node), r, c)]
                yield pa.record_batch(
                    [pa.array(node[on]), pa.array(links[on].astype(np.int64)), pa.array(root[on])], names=["node", "links", "root"]
                )

    found = written(both.mapInArrow(link, "node long, links long, root long"), "ego-links")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    return sums, components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "ego-components")


SQL = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (WITH RECURSIVE w(a, b) AS (SELECT a, b FROM l UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a) SELECT * FROM w),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
