"""Operator 13: alignment of two tokenizers' tokens by byte offsets, in Arrow tables inside Spark tasks."""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.common import batches_of, by_value, written
from surveyloom.llm.words import give_back, ranges, slices

# text whose tokens are aligned at once, and whose pairs are numbered together
TEXT_BYTES = 1 << 20
# rows handed to Python at once, words encoded as one text, and words kept with their ids
BATCH_ROWS, RUN_WORDS, KEPT_WORDS = 1000, 200, 150_000
# a pair is one number: the A id above these bits, the B id below
B_BITS = 24
# a place in a text is one number: the text above these bits, the byte offset below
END_BITS = 40
ALIGNED = pa.schema(
    [
        ("slice", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
        ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("entry", pa.list_(pa.int32())),
        ("times", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32())),
    ]
)
DDL = (
    "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " entry array<int>, times array<int>, pairs array<long>, docs array<int>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of a list of texts, and the bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = pa.array(tokens, pa.large_binary())
        self.size = pc.binary_length(self.bytes).to_numpy()
        self.names = pa.array([str(i) for i in range(len(tokens))], pa.string())

    def ids(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def joined(self, ids: np.ndarray) -> bytes:
        return self.bytes.take(pa.array(ids)).buffers()[2].to_pybytes() if len(ids) else b""


class ByteLevel(Side):
    """Byte-level BPE of a space and the text; special tokens' strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            added = {t["id"]: t["content"] for t in json.load(f).get("added_tokens", [])}
        letters, size = byte_letters(), 1 + max(self.model.get_vocab().values())
        names = [self.model.id_to_token(i) or "" for i in range(size)]
        super().__init__([s.encode() if i in added else bytes(letters[c] for c in s) for i, s in enumerate(names)])

    def ids(self, texts):
        return [e.ids for e in self.model.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]


class Pieces(Side):
    """Sentence pieces with byte fallback; the model adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        one = re.compile("<0x([0-9A-F]{2})>")
        super().__init__([bytes.fromhex(m[1]) if (m := one.fullmatch(s)) else s.replace("▁", " ").encode() for s in names])

    def ids(self, texts):
        return self.model.encode(texts, num_threads=1) if texts else []


def words_of(text: str | None) -> list[str]:
    """Parts of a text that both tokenizers encode alike alone and in the text.

    Neither joins letters with a space after them, so a text can be cut before
    single spaces. One with runs of spaces, or spaces at its ends, is one part.
    """
    if not text:
        return []
    return [text] if "  " in text or text[0] == " " or text[-1] == " " else text.split(" ")


class Words:
    """Ids of words by both tokenizers, each word encoded once while it is kept."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = (ByteLevel(a_path), Pieces(b_path))
        self.place: dict[str, int] = {}
        self.exact = np.zeros(0, bool)
        self.parts = [(np.zeros(0, np.int32), np.zeros(0, np.int64)) for _ in self.sides]  # ids, ids per word

    @staticmethod
    def of(a_path: str, b_path: str) -> Words:
        """Those of a worker process; they outlive the task."""
        name = "surveyloom_worker_store"
        store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
        if (a_path, b_path) not in store:
            store[(a_path, b_path)] = Words(a_path, b_path)
        return store[(a_path, b_path)]

    def learn(self, words: list[str]) -> None:
        """Words without spaces are encoded many at once, as one text, and cut again at their bytes."""
        words = sorted(words, key=lambda w: " " in w)
        plain = next((i for i, w in enumerate(words) if " " in w), len(words))
        runs = [words[i : min(i + RUN_WORDS, plain)] for i in range(0, plain, RUN_WORDS)] + [[w] for w in words[plain:]]
        coded = [_cut(s, [" ".join(r) for r in runs], runs) for s in self.sides]
        self.exact = np.concatenate((self.exact, np.logical_and(*[c[2] for c in coded])))
        self.parts = [tuple(np.concatenate(x) for x in zip(p, c[:2])) for p, c in zip(self.parts, coded)]
        n = len(self.place)
        self.place.update((w, n + i) for i, w in enumerate(words))

    def of_slice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list]:
        """(place of each word, whether a place's tokens are exact, ids and ids per place); new words go again if too many are kept."""
        new = [w for w in words if w not in self.place]
        before = self.exact, self.parts
        if new:
            self.learn(new)
        out = np.fromiter((self.place[w] for w in words), np.int64, len(words)), self.exact, self.parts
        if len(self.place) > KEPT_WORDS:
            for w in new:
                del self.place[w]
            self.exact, self.parts = before
        return out


def _cut(side: Side, texts: list[str], runs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all words, ids per word, whether a word's tokens join to a space and the word); texts are the words of runs.

    A run that its tokens do not join to is encoded word by word.
    """
    ids, sizes, exact = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for x, text, words in zip(side.ids(texts), texts, runs):
        one = np.array(x, np.int32)
        fits = side.joined(one) == f" {text}".encode()
        size = np.array([len(one)])
        if len(words) > 1:
            ends, cuts = np.cumsum(side.size[one]), np.cumsum([len(w.encode()) + 1 for w in words])
            at = np.searchsorted(ends, cuts)
            if fits and np.array_equal(ends[at], cuts):
                size = np.diff(at + 1, prepend=0)
            else:
                one, size, fits = _cut(side, words, [[w] for w in words])
        ids.append(one)
        sizes.append(size)
        exact.append(np.broadcast_to(fits, len(words)))
    return np.concatenate(ids), np.concatenate(sizes), np.concatenate(exact)


def encode(texts: list[str | None], known: Words) -> list[pa.LargeListArray]:
    """Ids of each text by both tokenizers; texts whose tokens do not join to them have none."""
    lists = [words_of(t) for t in texts]
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    coded = pa.array(chain.from_iterable(lists), pa.large_string()).dictionary_encode()
    at, exact, parts = known.of_slice(coded.dictionary.to_pylist())
    place, doc = at[coded.indices.to_numpy()], np.repeat(np.arange(len(lists)), count)
    bad = np.zeros(len(lists), bool)
    bad[doc[~exact[place]]] = True
    place, doc = place[~bad[doc]], doc[~bad[doc]]
    out = []
    for ids, size in parts:
        n = size[place]
        offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, n, len(lists)).astype(np.int64))))
        flat = ids[ranges((np.cumsum(size) - size)[place], n)]
        out.append(pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat)))
    return out


def ends_of(lists: pa.LargeListArray, size: np.ndarray, name: str) -> pa.Table:
    """(key, id): where each token ends, as text and byte offset in one number.

    Sizes are summed along the flat list; what a text begins with is taken off.
    """
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    run = pc.cumulative_sum(pa.array(size).take(ids))
    total = np.concatenate(([0], run.to_numpy()))
    start = pa.array(total[lists.offsets.to_numpy()]).take(doc)
    key = pc.add(pc.shift_left(doc.cast(pa.int64()), END_BITS), pc.subtract(run, start))
    return pa.table({"key": key, name: ids})


def _joined(names: pa.Array, per: np.ndarray, glue: str) -> pa.Array:
    offsets = pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, names), glue)


def align(ids: list[pa.LargeListArray], sides: tuple[Side, Side]) -> tuple[pa.Table, pa.Table]:
    """(counts and group hash per text, links as text, A id, B id) of the texts of a slice.

    A full outer join of the ends of A and B tokens: where both end, a group
    ends. In order, every end closes one stretch of bytes within one A and one B
    token, and two stretches never share both tokens: the rows are the links, and
    a token that ends later is the next one below.
    """
    n = len(ids[0])
    a, b = (ends_of(x, s.size, c) for x, s, c in zip(ids, sides, "ab"))
    met = a.join(b, "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    has = [met[c].is_valid().to_numpy() for c in "ab"]
    both = has[0] & has[1]
    doc = pc.shift_right(met["key"], END_BITS).to_numpy()
    group = np.cumsum(both) - both
    n_groups = np.bincount(doc[both], minlength=n)
    per_side = [
        _joined(s.names.take(pc.list_flatten(x)), np.bincount(group[h], minlength=int(both.sum())), ",")
        for s, x, h in zip(sides, ids, has)
    ]
    texts = _joined(pc.binary_join_element_wise(*per_side, "|"), n_groups, ";").to_pylist()
    per = pa.table(
        {
            "n_a": pc.list_value_length(ids[0]), "n_b": pc.list_value_length(ids[1]), "n_groups": n_groups,
            "n_links": np.bincount(doc, minlength=n),
            "groups_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts],
        }
    )
    links = pa.table({"doc": doc, **{c: pc.fill_null_backward(met[c]) for c in "ab"}})
    return per, links


def _numbered(links: pa.Table, n: int) -> tuple[pa.Table, pa.Table]:
    """Distinct pairs of the slice with the texts that hold them, and each text's pairs by their number, with counts."""
    pair = pc.add(pc.shift_left(links["a"].cast(pa.int64()), B_BITS), links["b"].cast(pa.int64()))
    coded = pair.combine_chunks().dictionary_encode() if len(pair) else pa.array([], pa.int64()).dictionary_encode()
    held = pa.table({"doc": links["doc"], "entry": coded.indices})
    held = held.group_by(["doc", "entry"], use_threads=False).aggregate([([], "count_all")])
    held = held.sort_by([("doc", "ascending"), ("entry", "ascending")])
    per = held.group_by("entry", use_threads=False).aggregate([([], "count_all")]).sort_by("entry")
    pairs = pa.table({"pair": coded.dictionary, "docs": per["count_all"].cast(pa.int32())})
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(held["doc"].to_numpy(), minlength=n)))).astype(np.int32))
    lists = {k: pa.ListArray.from_arrays(offsets, held[c].combine_chunks().cast(pa.int32())) for k, c in (("entry", "entry"), ("times", "count_all"))}
    return pairs, pa.table(lists)


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.record_batch([columns.get(f.name, pa.nulls(n, f.type)) for f in ALIGNED], schema=ALIGNED)


def _flattened(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    return column.combine_chunks().cast(kind) if column.num_chunks != 1 else column.chunk(0).cast(kind)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table: one row per document with its counts and its pairs by number, and one per slice with its pairs.

    A slice is some TEXT_BYTES of text, one document at least. Its pairs are
    numbered, so a document names them by small numbers, and the corpus-wide
    counts are asked for once per slice and pair, not once per document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        known = Words.of(a_path, b_path)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                ids = encode(part.column("text").to_pylist(), known)
                per, links = align(ids, known.sides)
                pairs, held = _numbered(links, part.num_rows)
                own = {f.name: _flattened(c, f.type) for t in (per, held) for f, c in ((ALIGNED.field(k), t[k]) for k in t.column_names)}
                yield _rows(part.num_rows, slice=pa.repeat(pa.scalar(number, pa.int64()), part.num_rows), doc_id=part.column("doc_id"), **own)
                if pairs.num_rows:
                    one = {k: pa.ListArray.from_arrays(pa.array([0, pairs.num_rows], pa.int32()), pairs[c].combine_chunks()) for k, c in (("pairs", "pair"), ("docs", "docs"))}
                    yield _rows(1, slice=pa.array([number]), **one)
                number += 1
            give_back()

    by_value("surveyloom.llm.words", __name__)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return written(slim.mapInArrow(run, DDL), "align")


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold a pair of ids linked, and whether no pair of its A id has more."""
    each = table.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
    counts = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("x.docs").cast("long")).alias("count"))
    # an A id has as many pairs as there are B ids, at most
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", B_BITS)))
    return written(counts.withColumn("best", F.col("count") == most), "align-counts")


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null or empty texts, and texts that a tokenizer does not give back byte by
    byte, have no tokens: zeros and an empty hash. Null ids, and rows of equal ids
    or texts, are documents each for itself. A very long text is a slice of its
    own. No rows: none. Other columns of ``docs`` play no part.
    """
    table = aligned(docs, a_path, b_path, id_col, text_col)
    asked = table.where("pairs IS NOT NULL").select("slice", F.posexplode("pairs").alias("entry", "pair"))
    answers = asked.join(pair_counts(table), "pair").select(F.col("slice").alias("asked"), "entry", "count", "best")

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        """Counts of the slice's pairs, laid out by number, summed along each document's pairs."""
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        entry = right["entry"].to_numpy()
        count[entry], best[entry] = right["count"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        held, times = (left[c].combine_chunks() for c in ("entry", "times"))
        doc, at, times = pc.list_parent_indices(held), pc.list_flatten(held), pc.list_flatten(times)
        worth = {k: pc.multiply(pa.array(v).take(at), times) for k, v in (("n_best", best), ("count_sum", count))}
        per = pa.table({"doc": doc, **worth}).group_by("doc", use_threads=False).aggregate([(k, "sum") for k in worth])
        out = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        for k in worth:
            full = np.zeros(left.num_rows, np.int64)
            full[per["doc"].to_numpy()] = per[f"{k}_sum"].to_numpy()
            out = out.append_column(k, pa.array(full))
        return out.append_column("groups_sha256", left["groups_sha256"])

    own = table.where("pairs IS NULL").drop("pairs", "docs")
    return own.groupBy("slice").cogroup(answers.groupBy("asked")).applyInArrow(sums, RESULT)
