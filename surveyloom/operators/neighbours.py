"""Exact nearest-neighbour classification without comparing every pair.

Training rows are assigned to cells around a bounded number of pivot rows. A
query first meets its own cell, which bounds the distance of its k-th
neighbour; of another cell it then meets only the rows whose distance from the
pivot the triangle inequality allows to be that close. Cells are gathered into
groups of bounded size and queries into chunks, and a task compares one group
with one chunk, tile by tile, so rows travel once per group or chunk and not
once per tile. It returns at most k rows per query.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from surveyloom.operators.splits import hash_order
from surveyloom.session import fresh_path, materialise

# the functions below travel to the executors by value, which need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of a tile, which is compared at once: two arrays of 1 MB, with long rows for vector instructions.
BLOCK_ROWS = 4_096
CHUNK_ROWS = 64
# Training rows for each pivot, and so in each cell on average, up to so many pivots.
ROWS_PER_PIVOT = 4_000
MOST_PIVOTS = 256
# Most rows of either side in a task, and bytes of its vectors.
TASK_ROWS = 65_536
TASK_BYTES = 32 << 20
# Sides below these are not cut further; larger ones into so many groups or chunks, more only to keep a task bounded.
LEAST_TASK_ROWS = 2_048
GROUPS, CHUNKS = 16, 8
# Queries of a task that are answered at once, with all candidates that are still open.
QUERIES_AT_ONCE = 4_096


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a matrix from lists of one length."""
    column = column.combine_chunks()
    size = pc.min_max(pc.list_value_length(column))
    if size["min"] != size["max"]:
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size["max"].as_py() or 0)


def _distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Minkowski distances, summed dimension by dimension in column order."""
    total = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = np.abs(a[:, d, None] - b[None, :, d])
        total += gap if p == 1 else gap**p
    return total if p == 1 else total ** (1.0 / p)


def _pair_distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """The same sums for row i of both."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        gap = np.abs(a[:, d] - b[:, d])
        total += gap if p == 1 else gap**p
    return total if p == 1 else total ** (1.0 / p)


class _Tiles:
    """Pairs of a tile that may lie within a bound, found by cheaper sums with a margin for their rounding.

    p = 1 adds up single precision (double for few dimensions) and stops where
    few pairs are left, p = 2 is a matrix product. Vectors with infinite
    numbers and other powers are compared as they are.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, k: int, p: int):
        self.a, self.b, self.k, self.p = a, b, k, p
        n = a.shape[1]
        top = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
        self.plain = p not in (1, 2) or (p == 2 and not np.isfinite(top))
        kind = np.float32 if p == 1 and n > 16 and np.isfinite(top) else np.float64
        self.scale = top if np.isfinite(top) and 0 < top and (p == 2 or kind == np.float32) else 1.0
        self.margin = 0.0 if p == 1 and kind == np.float64 else 8.0 * n * (n + 2) * float(np.finfo(kind).eps)
        if not self.plain:
            small = [np.asarray(v / self.scale, kind) for v in (a, b)]
            # by columns, so that one dimension of many rows lies together
            self.left, self.right = small if p == 2 else [np.asfortranarray(v) for v in small]
            if p == 2:
                self.squares = [np.einsum("ij,ij->i", v, v) for v in small]
            self.kind = kind

    def _limits(self, rough: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Bounds in the terms of the sums; a query without one takes the k-th smallest of the tile."""
        if self.plain:
            limit = bound
        else:
            limit = (bound / self.scale) ** self.p * (1 + 1e-6) + self.margin
        open_ = np.isinf(limit)
        if open_.any() and rough.shape[1] > self.k:
            limit = limit.copy()
            kth = np.partition(rough[open_], self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)
            limit[open_] = np.fmin(limit[open_], kth * (1 + 1e-6) + 2 * self.margin)
        return limit

    def pairs(self, q: np.ndarray, lo: int, hi: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in q, training row) of the pairs of queries ``q`` and training rows lo to hi that may be near enough."""
        if self.plain:
            rough = _distances(self.a[q], self.b[lo:hi], self.p)
        elif self.p == 2:
            rough = self.left[q] @ self.right[lo:hi].T
            rough *= -2
            rough += self.squares[0][q, None]
            rough += self.squares[1][None, lo:hi]
        else:
            a, b = self.left[q], self.right[lo:hi]
            rough, gap = np.zeros((len(q), hi - lo), self.kind), np.empty((len(q), hi - lo), self.kind)
            closed = np.isfinite(bound).all()
            limit = self._limits(rough, bound)[:, None] if closed else None
            for d in range(a.shape[1]):
                np.subtract(a[:, d, None], b[None, :, d], out=gap)
                np.abs(gap, out=gap)
                rough += gap
                if closed and d % 8 == 7 and np.count_nonzero(rough <= limit) * 64 < rough.size:
                    break
        i, j = np.nonzero(rough <= self._limits(rough, bound)[:, None])
        return i, j + lo


class _Nearest:
    """The k nearest rows of some queries so far, and the distance beyond which no other counts."""

    def __init__(self, tiles: _Tiles, rank: np.ndarray, queries: np.ndarray, reach: np.ndarray):
        self.tiles, self.rank, self.queries, self.bound = tiles, rank, queries, reach.copy()
        self.kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.waiting = 0

    def meet(self, some: np.ndarray, lo: int, hi: int) -> None:
        """Compare the queries at places ``some`` with training rows lo to hi."""
        i, t = self.tiles.pairs(self.queries[some], lo, hi, self.bound[some])
        q = some[i]
        dist = _pair_distances(self.tiles.a[self.queries[q]], self.tiles.b[t], self.tiles.p)
        near = dist <= self.bound[q]
        self.kept.append((q[near], t[near], dist[near]))
        self.waiting += int(near.sum())
        if self.waiting > self.tiles.k * max(len(self.queries), 1_000):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Drop all but the k nearest, equal ones by id; nothing beyond the k-th counts any more."""
        q, t, dist = map(np.concatenate, zip(*self.kept))
        order = np.lexsort((self.rank[t], dist, q))
        q, t, dist = q[order], t[order], dist[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.tiles.k - 1
        self.bound[q[last]] = np.minimum(self.bound[q[last]], dist[last])
        first = place < self.tiles.k
        self.kept, self.waiting = [(q[first], t[first], dist[first])], 0
        return self.kept[0]


def _nearest_in_group(k: int, p: int, points: np.ndarray, own: bool | None, block_rows: int, chunk_rows: int, schema: pa.Schema):
    """Per query of a chunk the k nearest rows of a group of cells within its reach, ordered by distance and id.

    ``own`` says whether a query meets its own cell alone, the others alone, or (None) all of them.
    """

    def run(train: pa.Table, queries: pa.Table) -> pa.Table:
        if not train.num_rows or not queries.num_rows:
            return schema.empty_table()
        cell, radius = train["cell"].to_numpy(), train["radius"].to_numpy()
        order = np.lexsort((radius, cell))
        cell, radius = cell[order], radius[order]
        train = train.select(["tid", "y", "x"]).take(order)
        rank = pc.rank(train["tid"].combine_chunks(), null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        b, a = _vectors(train["x"]), _vectors(queries["x"])
        if a.shape[1] != b.shape[1]:
            raise ValueError("vectors differ in length")
        home, reach = queries["cell"].to_numpy(), queries["reach"].to_numpy()
        tiles, parts = _Tiles(a, b, k, p), []
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        for at in range(0, len(a), QUERIES_AT_ONCE):
            mine = np.arange(at, min(at + QUERIES_AT_ONCE, len(a)))
            found = _Nearest(tiles, rank, mine, reach[mine])
            for first, end in zip(starts, [*starts[1:], len(cell)]):
                c = cell[first]
                who = np.arange(len(mine)) if own is None else np.flatnonzero((home[mine] == c) == own)
                if not len(who):
                    continue
                far = _distances(a[mine[who]], points[c : c + 1], p)[:, 0] if len(points) else np.zeros(len(who))
                for lo in range(first, end, block_rows):
                    hi = min(lo + block_rows, end)
                    # a little slack for rounding in the distances
                    closest = np.maximum(far - radius[hi - 1], radius[lo] - far) * (1 - 1e-9) - 1e-9
                    some = who[~(closest > found.bound[who])] if len(points) else who
                    for s in range(0, len(some), chunk_rows):
                        found.meet(some[s : s + chunk_rows], lo, hi)
                    if np.isinf(found.bound[some]).any():
                        found.settle()
            parts.append((found.settle(), at))
        q = np.concatenate([q + at for (q, _, _), at in parts])
        t, dist = (np.concatenate([f[i] for f, _ in parts]) for i in (1, 2))
        columns = [queries["qid"].take(q), train["tid"].take(t), train["y"].take(t), pa.array(dist)]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _home(points: np.ndarray, p: int):
    """The cell of a vector, that of the nearest pivot, and its distance."""

    @F.pandas_udf("cell int, radius double")
    def home(x: pd.Series) -> pd.DataFrame:
        parts = []
        for at in range(0, len(x), 1_000):
            far = _distances(_matrix(x.iloc[at : at + 1_000]), points, p)
            far[np.isnan(far)] = np.inf
            cell = far.argmin(axis=1)
            parts.append(pd.DataFrame({"cell": cell.astype(np.int32), "radius": far[np.arange(len(far)), cell]}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"cell": [], "radius": []})

    return home


def _reachable(points: np.ndarray, p: int, lo: np.ndarray, hi: np.ndarray, members: np.ndarray):
    """The groups that hold a row a query may reach in another cell than its own; members[cell, group] tells what they hold."""

    @F.pandas_udf("array<int>")
    def groups(x: pd.Series, cell: pd.Series, reach: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(x), 1_000):
            far = _distances(_matrix(x.iloc[at : at + 1_000]), points, p)
            closest = np.maximum(far - hi, lo - far) * (1 - 1e-9) - 1e-9
            go = ~(closest > reach.to_numpy()[at : at + 1_000, None])
            go[np.arange(len(go)), cell.to_numpy()[at : at + 1_000]] = False
            out += [np.flatnonzero(row).astype(np.int32) for row in go.astype(np.float32) @ members]
        return pd.Series(out, dtype=object)

    return groups


def _groups(cells: dict[int, int], order: Sequence[int], most: int) -> dict[int, tuple[int, int]]:
    """First group and number of groups of each cell: neighbouring cells share one up to ``most`` rows, larger ones are cut."""
    out, group, filled = {}, 0, 0
    for c in order:
        n = cells.get(c, 0)
        if not n:
            continue
        if filled and filled + n > most:
            group, filled = group + 1, 0
        pieces = math.ceil(n / most)
        out[c] = (group, pieces)
        if pieces > 1:
            group, filled = group + pieces, 0
        else:
            filled += n
    return out


def _of(values: dict[int, int], key: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), F.col(key))


def _meet(train: DataFrame, visits: DataFrame, chunks: dict[int, int], run, schema: str) -> DataFrame:
    """Candidates from the (query, group) visits: a group meets its queries in so many chunks.

    train has tid, y, x, cell, radius, group and visits qid, x, cell, reach, group.
    """
    keys, n = ["group", "chunk"], _of(chunks, "group")
    left = train.where(F.col("group").isin(list(chunks))).withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    right = visits.withColumn("chunk", F.pmod(F.xxhash64("qid", "x"), n).cast("int"))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _best(candidates: DataFrame, k: int) -> DataFrame:
    # the constant bound lets every task keep only k rows per query before the shuffle
    order = Window.partitionBy("qid").orderBy("dist", "tid")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    train: DataFrame,
    queries: DataFrame,
    k: int,
    p: int = 1,
    block_rows: int = BLOCK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    pivots: int | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """The k nearest training rows per query: (qid, tid, y, dist, rank).

    train has (tid, y, x) and queries (qid, x), x being array<double>; ids are
    unique. Equal distances are ordered by ``tid``. Null vectors and those that
    hold null or NaN are near nothing. A task compares ``block_rows`` training
    rows with ``chunk_rows`` queries at once and holds at most about
    ``task_rows`` of either.
    """
    # both sides may stem from one table: new aliases keep their columns apart
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
    train = train.select(*[F.col(c).alias(c) for c in ("tid", "y", "x")]).where(whole)
    queries = queries.select(*[F.col(c).alias(c) for c in ("qid", "x")]).where(whole)
    # of equal vectors only the k smallest ids can be among the nearest
    copies = Window.partitionBy("x").orderBy("tid")
    train = train.withColumn("_c", F.row_number().over(copies)).filter(F.col("_c") <= k).drop("_c")
    # both are read several times below
    train, queries = materialise(train, "knn-train"), materialise(queries, "knn-queries")
    n, m = train.count(), queries.count()
    if pivots is None:
        pivots = min(math.ceil(n / ROWS_PER_PIVOT), MOST_PIVOTS)
    finite = F.forall("x", lambda v: F.abs(v) < float("inf"))
    chosen = []
    if pivots > 1:
        chosen = train.where(finite).orderBy(hash_order("pivot", F.col("tid")), "tid").limit(pivots).select("x").collect()
    points = np.unique(np.array([r["x"] for r in chosen], dtype=np.float64), axis=0) if chosen else np.zeros((0, 1))
    wide = train.select(F.max(F.size("x"))).first()[0] or 1
    task_rows = max(1, min(task_rows, TASK_BYTES // (8 * max(wide, 1))))

    def at_most(rows: int, parts: int) -> int:
        return min(task_rows, max(LEAST_TASK_ROWS, math.ceil(rows / parts)))

    most, asked_at_once = at_most(n, GROUPS), at_most(m, CHUNKS)
    if len(points):
        home = _home(points, p)
        placed = materialise(train.withColumn("h", home("x")).select("tid", "y", "x", "h.cell", "h.radius"), "knn-train")
        asked = materialise(queries.withColumn("h", home("x")).select("qid", "x", "h.cell"), "knn-queries")
    else:
        one = F.lit(0).alias("cell")
        placed, asked = train.select("*", one, F.lit(0.0).alias("radius")), queries.select("*", one)
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi"))
    cells = {r["cell"]: r for r in stats.collect()}
    # cells around near pivots share a group
    order = np.argsort(_distances(points, points[:1], p)[:, 0], kind="stable").tolist() if len(points) else [0]
    groups = _groups({c: r["n"] for c, r in cells.items()}, order, most) or {0: (0, 1)}
    first, pieces = _of({c: g for c, (g, _) in groups.items()}, "cell"), _of({c: g for c, (_, g) in groups.items()}, "cell")
    placed = placed.withColumn("group", (first + F.pmod(F.xxhash64("tid", "x"), pieces)).cast("int"))
    fields = {f.name: f for f in (*train.schema.fields, *queries.schema.fields)}
    schema = ", ".join(f"{c} {fields[c].dataType.simpleString()}" for c in ("qid", "tid", "y")) + ", dist double"
    arrow = to_arrow_schema(train.sparkSession.createDataFrame([], schema).schema)

    def search(own: bool | None):
        return _nearest_in_group(k, p, points, own, block_rows, chunk_rows, arrow)

    # own cells first, or all there is
    held = asked.groupBy("cell").count().collect()
    chunks: dict[int, int] = {}
    for r in held:
        g, parts = groups.get(r["cell"], (0, 0))
        for i in range(g, g + parts):
            chunks[i] = chunks.get(i, 0) + r["count"]
    chunks = {g: math.ceil(rows / asked_at_once) for g, rows in chunks.items()} or {0: 1}
    homes = asked.withColumn("group", F.explode(F.sequence(first, first + pieces - 1)))
    homes = homes.withColumn("reach", F.lit(float("inf")))
    own = _best(_meet(placed, homes, chunks, search(True if len(points) else None), schema), k)
    if not len(points):
        return own

    found = materialise(own.drop("rank"), "knn-own")
    reach = found.groupBy("qid").agg(
        F.when(F.count("*") >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("reach")
    )
    members = np.zeros((len(points), max(g + parts for g, parts in groups.values())), np.float32)
    for c, (g, parts) in groups.items():
        members[c, g : g + parts] = 1
    # cells without rows are never reached
    lo, hi = (np.array([cells[c][end] if c in cells else other for c in range(len(points))]) for end, other in (("lo", np.inf), ("hi", -np.inf)))
    visits = asked.join(reach, "qid", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    go = _reachable(points, p, lo, hi, members)("x", "cell", "reach")
    # rows of one id ask together: each of their visits is made with the vector of each
    visits = visits.select("qid", "cell", "reach", go.alias("go")).join(asked.select("qid", "x"), "qid")
    visits = visits.withColumn("group", F.explode("go")).drop("go")
    chunks = {g: math.ceil(m / asked_at_once) or 1 for g in range(members.shape[1])}
    more = _meet(placed, visits, chunks, search(False), schema)
    return _best(found.unionByName(more), k)


def vote(neighbours: DataFrame, weights: str = "distance") -> DataFrame:
    """(qid, pred, nearest, farthest): class with the most weight, the smaller class on a tie.

    "distance" weighs by 1/distance; where neighbours at distance 0 exist only those vote.
    """
    near = F.col("dist")
    if weights == "uniform":
        zero, weight = F.lit(0), F.count("*").cast("double")
    else:
        zero, weight = F.count_if(near == 0), F.coalesce(F.sum(F.when(near > 0, 1.0 / near)), F.lit(0.0))
    per_class = neighbours.groupBy("qid", "y").agg(
        zero.alias("zero"), weight.alias("weight"), F.min("dist").alias("lo"), F.max("dist").alias("hi")
    )
    strength = F.struct(F.col("zero"), F.when(F.col("zero") == 0, F.col("weight")).otherwise(0.0).alias("w"))
    # max_by on (strength, -class) would need a negation for any type; two steps do not
    ranked = per_class.withColumn("s", strength)
    top = Window.partitionBy("qid").orderBy(F.desc("s"), F.asc("y"))
    own = Window.partitionBy("qid")
    ends = {"nearest": F.min("lo").over(own), "farthest": F.max("hi").over(own)}
    best = ranked.withColumns({"r": F.row_number().over(top), **ends}).filter(F.col("r") == 1)
    return best.select("qid", F.col("y").alias("pred"), "nearest", "farthest")


def vote_grid(neighbours: DataFrame, ks: Sequence[int], weights: Sequence[str] = ("uniform", "distance")) -> DataFrame:
    """Predictions of all settings from one list of neighbours: (qid, k, weights, pred).

    ``neighbours`` holds the largest k of every query. A neighbour counts for each k
    that its rank reaches, so all settings come from one aggregation. Under
    ``distance`` a class with more neighbours at distance 0 wins before any other.
    """
    grid = neighbours.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k")
    near = F.sum(F.when(F.col("dist") == 0, 1).otherwise(0))
    per = grid.groupBy("qid", "k", "y").agg(
        F.count("*").cast("double").alias("votes"), near.cast("double").alias("zero"),
        F.sum(F.when(F.col("dist") > 0, 1 / F.col("dist")).otherwise(0.0)).alias("near"),
    )
    score = {
        "uniform": (F.col("votes"), F.lit(0.0)),
        "distance": (F.col("zero"), F.when(F.col("zero") == 0, F.col("near")).otherwise(0.0)),
    }
    each = F.array(*[F.struct(F.lit(w).alias("weights"), score[w][0].alias("a"), score[w][1].alias("b")) for w in weights])
    each = per.select("qid", "k", "y", F.inline(each))
    top = Window.partitionBy("qid", "k", "weights").orderBy(F.desc("a"), F.desc("b"), F.asc("y"))
    return each.withColumn("r", F.row_number().over(top)).where("r = 1").select("qid", "k", "weights", F.col("y").alias("pred"))


def _as_array(df: DataFrame, col: str) -> Column:
    if isinstance(df.schema[col].dataType, VectorUDT):
        return vector_to_array(F.col(col))
    return F.col(col).cast("array<double>")


class _NeighbourParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector or array of numbers", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "unique row id", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "class", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "output", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    p = Param(Params._dummy(), "p", "Minkowski power", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "distance or uniform", TypeConverters.toString)

    def _defaults(self):
        self._setDefault(
            featuresCol="features", idCol="row_id", labelCol="label", predictionCol="prediction",
            k=27, p=1, weights="distance",
        )


class _VectorsWriter(DefaultParamsWriter):
    """Writes the training vectors beside the parameters."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.vectors().write.parquet(f"{path}/vectors")


class _VectorsReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        return model._set(table=f"{path}/vectors")


class NeighboursModel(Model, _NeighbourParams, DefaultParamsReadable, DefaultParamsWritable):
    """The training vectors are a table: in the shared folder after a fit, beside the parameters once saved.

    Unlike other models it runs jobs when it transforms: the reach of every
    query is known only after it met its own cell.
    """

    table = Param(Params._dummy(), "table", "path of the training vectors", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._defaults()

    def vectors(self) -> DataFrame:
        return SparkSession.active().read.parquet(self.getOrDefault(self.table))

    def write(self) -> DefaultParamsWriter:
        return _VectorsWriter(self)

    @classmethod
    def read(cls) -> DefaultParamsReader:
        return _VectorsReader(cls)

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        train = self.vectors()
        queries = df.select(F.col(get(self.idCol)).alias("qid"), _as_array(df, get(self.featuresCol)).alias("x"))
        pred = vote(nearest(train, queries, get(self.k), get(self.p)), get(self.weights))
        pred = pred.select("qid", F.col("pred").cast("double").alias(get(self.predictionCol)))
        return df.join(pred, F.col(get(self.idCol)) == F.col("qid"), "left").drop("qid")


class Neighbours(Estimator, _NeighbourParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featuresCol=None, idCol=None, labelCol=None, predictionCol=None, k=None, p=None, weights=None):
        super().__init__()
        self._defaults()
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> NeighboursModel:
        get = self.getOrDefault
        path = fresh_path(df.sparkSession, "neighbours")
        df.select(
            F.col(get(self.idCol)).alias("tid"),
            F.col(get(self.labelCol)).alias("y"),
            _as_array(df, get(self.featuresCol)).alias("x"),
        ).write.parquet(path)
        model = NeighboursModel()._set(table=path)
        return self._copyValues(model)


def project(df: DataFrame, names: Sequence[str], out: str = "x") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(f"`{c}`").cast("double") for c in names]))
