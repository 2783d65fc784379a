"""Operator 7: exact top-k search by inner product over vectors sorted by length."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.common import by_value, numbered, written
from surveyloom.llm.vectors import matrix, rotation, usable

# Rows of a block of queries and of a chunk of candidates; fewer where their vectors are above MOST_BYTES.
BLOCK = 256
CHUNK = 2048
MOST_BYTES = 4 << 20
# Bytes of query vectors that a task holds, runs of chunks (more where a task would compare more than PAIRS) and tasks.
HELD = 32 << 20
RUNS = 64
PAIRS = 1 << 33
TASKS = 4096
# Places of chunks whose length goes to the driver; a fixed number at any size.
MARKS = 1024
PACKED = "block long, top double, n int, ids binary, rows binary"
_SCHEMA = pa.schema(
    [("block", pa.int64()), ("top", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary())]
)


def whole_numbers(df: DataFrame, vector_col: str, factor: int = 256) -> DataFrame:
    """Each component x as floor(factor * x), in doubles; unusable vectors go."""
    out = usable(df, vector_col)
    return out.withColumn(
        vector_col, F.transform(vector_col, lambda x: F.floor(x * F.lit(float(factor))).cast("double"))
    )


def packed(df: DataFrame, dims: int, most: int, name: str) -> DataFrame:
    """Rows (id, vector, norm) of each partition in their order, ``most`` to a binary row, as a written table."""

    def run(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        ids, rows, norms = [], [], []

        def out(last: bool):
            nonlocal ids, rows, norms, n
            i, r, m = np.concatenate(ids), np.concatenate(rows), np.concatenate(norms)
            end = len(i) if last else len(i) - len(i) % most
            for a in range(0, end, most):
                b = min(a + most, end)
                values = [[base + n], [m[a:b].max()], [b - a], [i[a:b].tobytes()], [r[a:b].tobytes()]]
                yield pa.record_batch([pa.array(v, f.type) for v, f in zip(values, _SCHEMA)], schema=_SCHEMA)
                n += 1
            ids, rows, norms = [i[end:]], [r[end:]], [m[end:]]

        for b in batches:
            ids.append(b.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
            rows.append(matrix(b.column(1), dims).astype("<f8"))
            norms.append(b.column(2).to_numpy(zero_copy_only=False))
            if sum(map(len, ids)) >= most:
                yield from out(False)
        if ids:
            yield from out(True)

    return written(df.select("id", "vector", "norm").mapInArrow(run, PACKED), name)


class Turned(NamedTuple):
    """Vectors with their rotated components, their lengths and the lengths of what is left after each step."""

    ids: np.ndarray
    rows: np.ndarray
    turned: np.ndarray
    size: np.ndarray
    rest: list[np.ndarray]

    def part(self, a: int, b: int) -> Turned:
        return Turned(self.ids[a:b], self.rows[a:b], self.turned[a:b], self.size[a:b], [r[a:b] for r in self.rest])


def _steps(dims: int) -> list[int]:
    return sorted({dims // 8, dims // 4, dims // 2} - {0})


def turned(ids: np.ndarray, rows: np.ndarray, turn: np.ndarray) -> Turned:
    out = rows @ turn
    rest = [np.linalg.norm(out[:, h:], axis=1) for h in _steps(rows.shape[1])]
    return Turned(ids, rows, out, np.linalg.norm(rows, axis=1), rest)


def _unpack(ids, rows, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<f8").reshape(-1, dims)


def _living(i, c, alive, partial):
    """Without the queries and candidates that no pair is left of, if these are many."""
    rows, columns = alive.any(axis=1), alive.any(axis=0)
    if 4 * np.count_nonzero(rows) * np.count_nonzero(columns) > 3 * alive.size:
        return i, c, alive, partial
    at = np.ix_(rows, columns)
    return i[rows], c[columns], alive[at], partial[at]


def _places(alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(alive), max(1, alive.shape[1]))


def best(q: Turned, v: Turned, least: np.ndarray, k: int):
    """The pairs that reach the query's ``least``: (query row, score, id) arrays.

    A candidate goes as soon as the sum over the leading rotated components plus
    the product of both remainders' lengths stays below ``least``. Where many are
    left, those below the query's k-th best go too; ties with it stay.
    """
    top = v.size.max(initial=0)
    floor = least - 1e-9 * (1 + q.size * top)
    i, c = np.flatnonzero(q.size * top >= floor), np.arange(len(v.ids))
    alive = q.size[i, None] * v.size >= floor[i, None]
    partial, at = np.zeros(alive.shape), 0
    for h, q_rest, v_rest in zip(_steps(q.rows.shape[1]), q.rest, v.rest):
        i, c, alive, partial = _living(i, c, alive, partial)
        partial += q.turned[i, at:h] @ v.turned[c, at:h].T
        reach = np.multiply.outer(q_rest[i], v_rest[c])
        reach += partial
        alive &= reach >= floor[i, None]
        at = h
    i, c, alive, _ = _living(i, c, alive, partial)
    if np.isin(q.ids[i], v.ids[c]).any():
        alive &= q.ids[i, None] != v.ids[c]
    if np.count_nonzero(alive) <= alive.size >> 5:
        a, b = _places(alive)
        s = [np.einsum("ij,ij->i", q.rows[i[a[x : x + CHUNK]]], v.rows[c[b[x : x + CHUNK]]]) for x in range(0, len(a), CHUNK)]
        s = np.concatenate([np.zeros(0), *s])
    else:
        s = q.rows[i] @ v.rows[c].T
        s[~alive] = -np.inf
        alive &= s >= least[i, None]
        if np.count_nonzero(alive) > 4 * k * len(i) and k < len(c):
            alive &= s >= np.partition(s, len(c) - k, axis=1)[:, len(c) - k, None]
        a, b = _places(alive)
        s = s[a, b]
    s = np.rint(s).astype(np.int64)  # whole numbers below 2^53: exact
    ok = s >= least[i[a]]
    return i[a[ok]], s[ok], v.ids[c[b[ok]]]


def leading(rows, scores, ids, k: int):
    """Of each query row the k best, in order: larger scores first, then smaller ids."""
    o = np.lexsort((ids, -scores, rows))
    o = o[np.arange(len(o)) - np.searchsorted(rows[o], rows[o]) < k]
    return rows[o], scores[o], ids[o]


class Asking:
    """Queries of a task with their k best candidates so far; ``least`` rises with them."""

    def __init__(self, q: Turned, least: np.ndarray, k: int):
        self.q, self.least, self.k = q, least, k
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(3))

    def meet(self, v: Turned) -> None:
        found = [self.kept]
        for a in range(0, len(self.least), BLOCK):
            r, s, ids = best(self.q.part(a, a + BLOCK), v, self.least[a : a + BLOCK], self.k)
            if len(r):
                found.append((r + a, s, ids))
        if len(found) > 1:
            self.kept = r, s, _ = leading(*map(np.concatenate, zip(*found)), self.k)
            got = np.bincount(r, minlength=len(self.least))
            full = got == self.k
            self.least[full] = np.maximum(self.least[full], s[np.cumsum(got)[full] - 1])


def dealt(rows: dict[int, int], most: int) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """Groups of about ``most`` queries that need about as many chunks.

    ``rows``: queries by the number of chunks they need. For each number the first
    group and how many groups there are; for each group the largest number, never rising.
    """
    of, ends, room = {}, [], 0
    for last in sorted(rows, reverse=True):
        if rows[last] <= room:
            of[last] = (len(ends) - 1, 1)
            room -= rows[last]
        else:
            parts = -(-rows[last] // most)
            of[last] = (len(ends), parts)
            ends += [last] * parts
            room = most - rows[last] if parts == 1 else 0
    return of, ends


def _numbers(values) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col="vec_id", vector_col="embedding", factor: int = 256) -> DataFrame:
    """The k candidates of largest inner product of every query: query_id, rank, vec_id, score.

    Components are whole numbers floor(factor * x). Candidates are all rows of
    ``vectors`` with another id than the query's; equal scores go by the smaller
    id. Candidates are sorted by length over the whole table and packed in
    chunks. The chunk of the longest gives every query a first k-th best score;
    by Cauchy-Schwarz only chunks of long enough vectors can beat it, and only
    those meet the query's block. Blocks are put together in groups and chunks
    in runs: a task has a group and a run, so a chunk travels once for each
    group and a block once for each run. There, sums over rotated components
    drop candidates early (see ``best``) and the k-th best rises from chunk to
    chunk.

    Vectors that are null or hold a null or non-finite component, and null ids,
    take no part. A shorter vector counts as ending in zeros; an empty one
    scores 0. Fewer candidates than k: all. Repeated ids of queries are each
    answered. No rows: none. Inner products must stay below 2^53.
    """
    by_value("surveyloom.llm.vectors", __name__)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))

    def prepared(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null")
        return whole_numbers(df, "vector", factor).withColumn("norm", norm)

    spark = vectors.sparkSession
    rows = prepared(vectors)
    dims = rows.agg(F.max(F.size("vector"))).first()[0]
    result = "query_id long, rank int, vec_id long, score long"
    if not dims:
        return _zeros(rows, prepared(queries), k) if dims == 0 else spark.createDataFrame([], result)
    turn = rotation(rows, "vector", dims)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("norm").desc(), F.col("id")]
    most = max(1, MOST_BYTES // (8 * dims))
    chunks = packed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order), dims, min(CHUNK, most), "topk-chunks")
    blocks = packed(prepared(queries), dims, min(BLOCK, most), "topk-queries")
    places = numbered(chunks.select("block", "top", "n"), [F.col("top").desc(), F.col("block")], "place", "topk-places")
    places = written(places, "topk-numbered")
    total = places.count()
    step = max(1, -(-total // MARKS))
    marks = sorted((r["place"], r["top"]) for r in places.where(F.col("place") % step == 0).collect())
    head = chunks.join(places.where("place = 0").select("block"), "block", "left_semi").first()
    longest = turned(*_unpack(head["ids"], head["rows"], dims), turn)
    at, tops = np.array([m[0] for m in marks]), np.array([m[1] for m in marks])

    def bounds(batches):
        for b in batches:
            least, last = [], []
            for ids, data in zip(b.column("ids"), b.column("rows")):
                q = turned(*_unpack(ids.as_buffer(), data.as_buffer(), dims), turn)
                first = Asking(q, np.full(len(q.ids), -np.inf), k)
                first.meet(longest)
                t = first.least
                # a longer candidate than this may still reach the k-th best
                need = np.where(t > 0, t / np.maximum(q.size, 1e-300), -np.inf).min() * (1 - 1e-9)
                far = np.flatnonzero(tops < need)
                last.append(int(at[far[0]]) if len(far) else total)
                least.append(t.tobytes())
            yield pa.record_batch(
                [b.column("block"), b.column("n"), b.column("ids"), b.column("rows"), pa.array(least, pa.binary()), pa.array(last, pa.int64())],
                names=["block", "n", "ids", "rows", "least", "last"],
            )

    asked = written(blocks.mapInArrow(bounds, "block long, n int, ids binary, rows binary, least binary, last long"), "topk-asked")
    sizes = {r["last"]: r["n"] for r in asked.groupBy("last").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], result)
    room = max(1, HELD // (8 * dims))
    of, ends = dealt(sizes, room)
    pairs = total * min(CHUNK, most) * min(room, sum(sizes.values()))
    width = -(-total // min(total, max(RUNS, -(-pairs // PAIRS))))
    runs = -(-total // width)

    lasts = sorted(of)
    known = F.array_position(_numbers(lasts), F.col("last")).cast("int")
    first, parts = (F.element_at(_numbers(of[x][j] for x in lasts), known) for j in (0, 1))
    asking = asked.withColumn("group", first + F.pmod(F.xxhash64("block"), parts))
    asking = asking.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - 1) / width))))
    asking = asking.select("group", "run", F.lit(0).alias("kind"), F.col("block").alias("at"), "ids", "rows", "least")
    group = F.filter(_numbers(range(len(ends))), lambda g: F.element_at(_numbers(ends), g.cast("int") + 1) > F.col("place"))
    told = chunks.join(places.select("block", "place"), "block").withColumn("group", F.explode(group))
    told = told.select("group", F.floor(F.col("place") / width).alias("run"), F.lit(1).alias("kind"), F.col("place").alias("at"), "ids", "rows", F.lit(b"").alias("least"))
    cell = F.col("group") * runs + F.col("run")
    met = asking.unionByName(told).select(cell.alias("cell"), "kind", "at", "ids", "rows", "least")
    tasks = min(len(ends) * runs, TASKS)
    met = met.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell", "kind", "at")

    def search(batches):
        here, asks, parts, names = None, None, [], []

        def out():
            r, s, ids = asks.kept
            block, row = (np.concatenate([x[j] for x in names])[r] for j in (0, 1))
            return pa.record_batch(
                [pa.array(block), pa.array(row), pa.array(asks.q.ids[r]), pa.array(ids), pa.array(s)],
                names=["block", "row", "query_id", "vec_id", "score"],
            )

        for b in batches:
            for cell, kind, at, *data in zip(*map(b.column, ("cell", "kind", "at", "ids", "rows", "least"))):
                if cell.as_py() != here:
                    if asks:
                        yield out()
                    here, asks, parts, names = cell.as_py(), None, [], []
                ids, rows, least = (x.as_buffer() for x in data)
                if kind.as_py() == 0:
                    parts.append((*_unpack(ids, rows, dims), np.frombuffer(least)))
                    names.append((np.full(len(parts[-1][0]), at.as_py()), np.arange(len(parts[-1][0]))))
                elif parts or asks:
                    if not asks:
                        q_ids, q, t = map(np.concatenate, zip(*parts))
                        asks, parts = Asking(turned(q_ids, q, turn), t, k), []
                    asks.meet(turned(*_unpack(ids, rows, dims), turn))
        if asks:
            yield out()

    found = met.mapInArrow(search, "block long, row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("block", "row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _zeros(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """All vectors are empty and all scores 0: the smallest ids are best."""
    low = [r["id"] for r in rows.select("id").orderBy("id").limit(k + 1).collect()]
    ids = F.array(*[F.lit(i).cast("long") for i in low])
    others = F.slice(F.filter(ids, lambda i: i != F.col("id")), 1, k)
    out = queries.select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "vec_id"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
