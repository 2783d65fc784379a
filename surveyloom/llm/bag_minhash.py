"""Operator 5: near-duplicate documents by BagMinHash over multisets of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import by_value, every, written
from surveyloom.llm.components import components
from surveyloom.llm.words import giving_back, slices, split

# 24 bands of 6 values: a pair of similarity 0.8 shares a band with probability 0.9993
BANDS = 24
ROWS = 6
# Pairs whose BagMinHash values agree less than this much below the similarity are not compared
# exactly: four deviations of the estimate, so one link in 30,000 at the very threshold.
SLACK = 0.14
# Ids of documents that share a bucket up to this number (some 100 MB) are broadcast to the texts.
BROADCAST_IDS = 2_000_000
# Frequencies of shingles are counted in so many bins; a prefix starts with the rarest.
BINS = 1 << 20
# Documents that share a prefix item meet in blocks of about this many.
BLOCK = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``width`` words, bounds of the texts); a shorter text is one run, an empty one none."""
    words, ids, bounds = split(texts, ("\n", "\t", "\r"))
    names = np.array(words.to_pylist(), dtype=object)
    codes = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    codes = mix(codes)[ids]
    size = np.diff(bounds)
    runs = np.where(size > 0, np.maximum(size - width + 1, 1), 0)
    ends = np.concatenate(([0], np.cumsum(runs)))
    first = np.repeat(bounds[:-1] - ends[:-1], runs) + np.arange(ends[-1])
    length = np.repeat(np.minimum(size, width), runs)
    out = np.zeros(len(first), np.uint64)
    for i in range(width):
        on = i < length
        at = np.where(on, first + i, 0)
        out = np.where(on, (out + codes[at] if len(codes) else out) * _STEP, out)
        out ^= out >> np.uint64(31)
    return mix(out), ends


def bags(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct runs of each text, sorted by text and hash."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return t[at], h[at], np.diff(np.append(at, len(h)))


def signatures(text: np.ndarray, h: np.ndarray, count: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """BagMinHash values of each text, (texts, m); two texts agree in one with their weighted Jaccard similarity.

    Weights are whole numbers. The levels of a weight are cut into strata (0, 1],
    (1, 2], (2, 4], ...; each (run, stratum) has a Poisson process of its width,
    seeded by run and stratum, whose points fall on a random value and level. A
    point counts if its level is within the weight, and a value keeps the
    earliest point. Processes advance together and stop as soon as they are later
    than all values of their text.
    """
    out = np.full((n_texts, m), np.inf)
    if not len(h):
        return out
    strata = np.ceil(np.log2(count)).astype(np.int64) + 1
    which = np.repeat(np.arange(len(h)), strata)
    stratum = np.arange(len(which)) - np.repeat(np.cumsum(strata) - strata, strata)
    lo = np.where(stratum == 0, 0, 2.0 ** (stratum - 1))
    width = np.where(stratum == 0, 1.0, lo)
    doc, weight = text[which], count[which].astype(np.float64)
    state = mix(h[which] + stratum.astype(np.uint64) * _STEP)
    time = np.zeros(len(which))
    flat = out.ravel()
    limit = np.full(n_texts, np.inf)
    unit = 2.0**-53
    while len(doc):
        state = state + _STEP
        a = mix(state)
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * unit) / width
        on = time < limit[doc]
        if not on.all():
            doc, state, time, lo, width, weight = (x[on] for x in (doc, state, time, lo, width, weight))
        b = mix(state ^ np.uint64(0xD1B54A32D192ED03))
        level = lo + width * ((b >> np.uint64(40)).astype(np.float64) / (1 << 24))  # in [lo, lo + width)
        hit = level < weight
        place = doc * m + ((b & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(flat, place[hit], time[hit])
        seen = np.unique(doc)
        limit[seen] = out[seen].max(axis=1)
    return out


def bands(values: np.ndarray, n_bands: int) -> np.ndarray:
    bits = np.ascontiguousarray(values).view(np.uint64).reshape(len(values), n_bands, -1)
    h = np.zeros(bits.shape[:2], np.uint64)
    for i in range(bits.shape[2]):
        h = mix((h ^ bits[:, :, i]) + _STEP)
    return h.view(np.int64)


def fingerprints(text, h, count, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sums of hashes over each text's multiset, and its size; equal for equal multisets."""
    c = count.astype(np.uint64)
    sums = []
    for seed in (np.uint64(1), np.uint64(2)):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ (seed * _STEP)) * c, dtype=np.uint64)))
        ends = np.searchsorted(text, np.arange(n_texts + 1))
        sums.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return sums[0], sums[1], np.bincount(text, count, n_texts).astype(np.int64)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """(id, f1, f2, n, bands, marks) of each row: fingerprint and number of its shingles, hashes of its bands, a byte of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                t, h, c = bags(*shingles(part.column("text"), width))
                f1, f2, n = fingerprints(t, h, c, part.num_rows)
                values = signatures(t, h, c, part.num_rows, BANDS * ROWS)
                b = bands(values, BANDS)
                marks = mix(values.view(np.uint64)).astype(np.uint8).view(np.int8)
                lists = pa.ListArray.from_arrays(np.arange(0, b.size + 1, BANDS, dtype=np.int32), pa.array(b.ravel()))
                marks = pa.ListArray.from_arrays(np.arange(0, marks.size + 1, BANDS * ROWS, dtype=np.int32), pa.array(marks.ravel()))
                columns = [part.column("id"), pa.array(f1), pa.array(f2), pa.array(n), lists, marks]
                yield pa.record_batch(columns, names=["id", "f1", "f2", "n", "bands", "marks"])

    return docs.mapInArrow(giving_back(run), "id long, f1 long, f2 long, n long, bands array<long>, marks array<tinyint>")


def _bagged(docs: DataFrame, width: int) -> DataFrame:
    """(id, bag) of each row: its multiset as sorted 64-bit numbers, the k-th copy of a shingle a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                t, h, c = bags(*shingles(part.column("text"), width))
                copy = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                items, text = mix(np.repeat(h, c) + copy.astype(np.uint64) * _STEP), np.repeat(t, c)
                items = items[np.lexsort((items, text))]
                ends = np.searchsorted(text, np.arange(part.num_rows + 1))
                cut = [items[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.record_batch([part.column("id"), pa.array(cut, pa.binary())], names=["id", "bag"])

    return docs.mapInArrow(giving_back(run), "id long, bag binary")


def _likely(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose values agree often enough to be worth an exact look."""
    met = pairs.join(marks.select(F.col("node").alias("a"), F.col("marks").alias("x")), "a")
    met = met.join(marks.select(F.col("node").alias("b"), F.col("marks").alias("y")), "b")
    same = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, e: n + e)
    return met.where(same >= (similarity - SLACK) * BANDS * ROWS).select("a", "b").distinct()


def _leads(now: DataFrame, turn: int) -> DataFrame:
    """(band, h, lead, lead_class, lead_n): of every bucket with more than one class the member that meets most others.

    A text from which many copies were made shares more buckets than its copies
    do, so it comes first and joins most of them at once. Members that led before
    do not lead again. Buckets that share members mostly have the same lead, and a
    pair that shares many bands is compared once.
    """
    first = F.col("meets"), F.xxhash64("node", F.lit(turn)).alias("e")
    what = [F.col("class").alias("lead_class"), F.col("node").alias("lead"), F.col("n").alias("lead_n")]
    lead = now.groupBy("band", "h").agg(
        F.max(F.when(~F.col("led"), F.struct(*first, *what))).alias("l"), F.min("class").alias("c1"), F.max("class").alias("c2")
    )
    return lead.where("c1 < c2 and l is not null").select("band", "h", "l.lead_class", "l.lead", "l.lead_n")


def _verified(pairs: DataFrame, data: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("bag_a"), batch.column("bag_b"))):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep[i] = both >= similarity * (len(p) + len(q) - both) - 1e-9
            out = batch.filter(pa.array(keep))
            yield pa.record_batch([out.column("a"), out.column("b")], names=["a", "b"])

    met = pairs.join(data.select(F.col("id").alias("a"), F.col("bag").alias("bag_a")), "a")
    met = met.join(data.select(F.col("id").alias("b"), F.col("bag").alias("bag_b")), "b")
    return met.select("a", "b", "bag_a", "bag_b").mapInArrow(giving_back(run), "a long, b long")


def _crowded(bags: DataFrame) -> np.ndarray:
    """How many items of ``bags`` fall into each bin, the same for every task that ranks items by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for x in batch.column("bag"):
                total += np.bincount((np.frombuffer(x.as_py(), np.uint64) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bin", "n"])

    got = bags.select("bag").mapInArrow(giving_back(run), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BINS, np.int64)
    out[got.column("bin").to_numpy()] = got.column("n").to_numpy()
    return out


def _prefixes(bags: DataFrame, similarity: float) -> DataFrame:
    """(node, class, n, at, item): the first items of each multiset, rarest first.

    Two multisets that reach ``similarity`` share one of them, whatever the order
    is, as long as it is the same for all.
    """
    crowded = bags.sparkSession.sparkContext.broadcast(_crowded(bags))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, items = [], [], []
            for i, x in enumerate(batch.column("bag")):
                bag = np.frombuffer(x.as_py(), np.uint64)
                seen = crowded.value[(bag % np.uint64(BINS)).astype(np.int64)]
                least = int(np.ceil(similarity * len(bag) - 1e-9))
                first = bag[np.lexsort((bag, seen))[: len(bag) - least + 1]]
                rows.append(np.full(len(first), i))
                at.append(np.arange(len(first)))
                items.append(first)
            if rows:
                take = pa.array(np.concatenate(rows))
                columns = [batch.column(c).take(take) for c in ("node", "class", "n")]
                columns += [pa.array(np.concatenate(at)), pa.array(np.concatenate(items).view(np.int64))]
                yield pa.record_batch(columns, names=["node", "class", "n", "at", "item"])

    return bags.select("node", "class", "n", "bag").mapInArrow(giving_back(run), "node long, class long, n long, at long, item long")


def _left(now: DataFrame, data: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of different classes that may reach ``similarity``, of all members of buckets with several classes.

    A prefix-filter join: the pairs share an item of their prefixes, and what
    follows their first common item is long enough. None that reaches it is left out.
    """
    mixed = now.groupBy("band", "h").agg(F.min("class").alias("c1"), F.max("class").alias("c2")).where("c1 < c2")
    still = now.join(mixed.select("band", "h"), ["band", "h"]).select("node", "class").distinct()
    bags = still.join(data.select(F.col("id").alias("node"), "bag"), "node")
    bags = written(bags.withColumn("n", F.expr("octet_length(bag) div 8").cast("long")), "near-open")
    rows = written(_prefixes(bags, similarity), "near-prefixes")
    per = rows.groupBy("item", "class").agg(F.count(F.lit(1)).alias("size"))
    met = per.groupBy("item").agg(
        F.max_by("class", F.struct("size", "class")).alias("top"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("classes")
    )
    blocks = F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")
    rows = rows.join(met.where("classes > 1").select("item", "top", blocks), "item")
    # of two members of different classes one is outside the item's largest class: that class is not paired with itself
    all_ = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = rows.where(F.col("class") != F.col("top")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = rest.select("item", "block", *[F.col(c).alias(f"{c}_x") for c in ("node", "class", "n", "at")])
    y = all_.select("item", "block", *[F.col(c).alias(f"{c}_y") for c in ("node", "class", "n", "at")])
    both = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    most = both >= similarity / (1 + similarity) * (F.col("n_x") + F.col("n_y")) - 1e-6
    pairs = x.join(y, ["item", "block"]).where((F.col("class_x") != F.col("class_y")) & most)
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8,
    most_rounds: int = 3,
) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class) and kept (whether it is that one).

    A document is the multiset of its runs of ``width`` words (as they stand
    between white space; a shorter text is one run). Rows of equal multisets are
    one candidate. BagMinHash values in bands give buckets. In each round every
    bucket takes the member that meets most others; it is compared with the members
    of all other classes there, so a bucket of any size costs one comparison for each
    of its members. Pairs whose values agree often enough are compared exactly. Rounds go on while they
    find links, ``most_rounds`` at most. What they leave is finished exactly: all
    members of buckets that still hold several classes are joined on the rarest
    items of their multisets, so that every pair of different classes there that
    reaches ``similarity`` is compared. Classes are components of the verified links.

    Null or empty text and null ids have no links; such a row is a class of its own
    (null for a null id). Rows of one id are one node of the graph, with the links of
    all its texts. No rows: none.
    Other columns play no part.
    """
    by_value("surveyloom.llm.words", __name__)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(_signed(slim, width), "near-signatures")
    real = signed.where("n > 0 and id is not null")
    groups = written(
        real.groupBy("f1", "f2", "n").agg(F.min("id").alias("node"), F.first("bands").alias("bands"), F.first("marks").alias("marks")), "near-groups"
    )
    rows = groups.select("node", "n", F.posexplode("bands").alias("band", "h"))
    shared = rows.groupBy("band", "h").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(rows.join(shared, ["band", "h"]), "near-members")
    crowd = written(members.groupBy("node").agg(F.sum("size").alias("meets")), "near-crowd")
    members = members.drop("size")
    few = crowd.count() <= BROADCAST_IDS
    known = F.broadcast(crowd.select("node")) if few else crowd.select("node")
    texts = slim.join(known, F.col("id") == F.col("node"), "left_semi")
    marks = written(groups.select("node", "marks").join(known, "node", "left_semi"), "near-marks")
    # an id may have several texts; equal ones are one row
    data = _bagged(texts, width).groupBy("id", F.xxhash64("bag").alias("key")).agg(F.min("bag").alias("bag"))
    data = written(data.drop("key"), "near-bags")
    classes, links, led = crowd.select("node", F.col("node").alias("class")).where("false"), None, None
    for turn in range(most_rounds):
        of = crowd.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
        of = of.withColumn("led", F.lit(False)) if led is None else of.join(led, "node", "left").fillna(False, ["led"])
        now = members.join(of, "node")
        lead = written(_leads(now, turn), f"near-leads-{turn}")
        again = lead.select(F.col("lead").alias("node"), F.lit(True).alias("led")).distinct()
        led = again if led is None else led.union(again).distinct()
        pairs = now.join(lead, ["band", "h"]).where(
            (F.col("class") != F.col("lead_class")) & (F.least("n", "lead_n") >= similarity * F.greatest("n", "lead_n"))
        )
        pairs = pairs.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        pairs = written(_likely(pairs, marks, similarity), f"near-pairs-{turn}")
        new = written(_verified(pairs, data, similarity), f"near-links-{turn}")
        links = new if links is None else links.union(new)
        found = new.count()
        if found:
            classes = written(
                components(links, f"near-classes-{turn}").select("node", F.col("component").alias("class")), f"near-classes-{turn}"
            )
        elif turn:
            break  # leads find no more
    now = members.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    new = written(_verified(written(_left(now, data, similarity), "near-pairs-left"), data, similarity), "near-links-left")
    if new.count():
        classes = written(
            components(links.union(new), "near-classes-left").select("node", F.col("component").alias("class")), "near-classes-left"
        )
    of = groups.select(F.col("f1").alias("a1"), F.col("f2").alias("a2"), F.col("n").alias("a3"), "node")
    of = of.join(classes, "node", "left").select("a1", "a2", "a3", F.coalesce("class", "node").alias("class"))
    on = every([signed["f1"] == of["a1"], signed["f2"] == of["a2"], signed["n"] == of["a3"], signed["id"].isNotNull()])
    out = signed.select("id", "f1", "f2", "n").join(of, on, "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("class", "id"))
    return out.select(F.col("id").alias("doc_id"), found.alias("class_id"), F.coalesce(found == F.col("id"), F.lit(True)).alias("kept"))
