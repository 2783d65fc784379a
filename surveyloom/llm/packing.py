"""Operator 10: bounded-space online packing of tokenized documents."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import batches_of, by_value, fresh, running_total, written
from surveyloom.llm.words import give_back, ranges, slices, split

PIECE = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()), ("fill", pa.int64()),
    ]
)
DDL = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean, fill long"
MERGED = 1 << 62
# words kept with their ids for the next batch; more are encoded once per batch
KEPT_WORDS = 250_000
# new words encoded as one line: the tokenizer's costs for a text are shared
JOINED = 128
# new words encoded at once
LEARNED = 8_192
# text tokenized at once; its arrays take some ten times as much
TEXT_BYTES = 2 << 20
# rows handed to Python at once
BATCH_ROWS = 1000
_PUNCTUATION = ".,!?;:|"


class Encoder:
    """Ids of words by a tokenizer that drops white space, each distinct word encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.words = pa.array([""], pa.large_string())
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(2, np.int64)  # the empty word has no ids

    @staticmethod
    def of(path: str) -> Encoder:
        """The encoder of a worker process; it outlives the task."""
        name = "surveyloom_worker_store"
        store = sys.modules.setdefault(name, types.ModuleType(name))
        if path not in store.__dict__:
            store.__dict__[path] = Encoder(path)
        return store.__dict__[path]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words and their number per word, a line of JOINED words at a time; where a token starts tells its word."""
        lines = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        coded = self.model.encode_batch(["\n".join(x) for x in lines], add_special_tokens=False)
        ids = [c.ids for c in coded]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        n = int(size.sum())
        spans = chain.from_iterable(c.offsets for c in coded)
        start = np.fromiter(chain.from_iterable(spans), np.int64, 2 * n)[::2]
        del coded
        # the words end to end, each with its line break; a token starts within its word
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        base = np.concatenate(([0], ends))[np.arange(len(lines)) * JOINED]
        word = np.searchsorted(ends, start + np.repeat(base, size), side="right")
        return np.fromiter(chain.from_iterable(ids), np.uint32, n), np.bincount(word, minlength=len(words))

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, ids per word).

        Punctuation after an ASCII letter is a token of its own, so words are
        looked up without it. They are looked up in Arrow: only new ones become
        Python strings.
        """
        words = words.cast(pa.large_string())
        core = pc.utf8_rtrim(words, characters=_PUNCTUATION)
        apart = pc.and_not(pc.match_substring_regex(core, "[a-z]$"), pc.match_substring(words, "<|"))
        apart = pc.and_(apart, pc.less(pc.binary_length(core), pc.binary_length(words)))
        tails = pc.replace_substring_regex(words.filter(apart), "^(?s:.*)[a-z]", "")
        asked = pa.concat_arrays([pc.if_else(apart, core, words), tails])
        found = pc.index_in(asked, value_set=self.words)
        unknown = asked.filter(found.is_null())
        new = unknown.unique()
        at = found.fill_null(0).to_numpy().astype(np.int64)
        at[found.is_null().to_numpy(zero_copy_only=False)] = len(self.words) + pc.index_in(unknown, value_set=new).to_numpy()
        names = new.to_numpy(zero_copy_only=False).tolist()
        got = [self._learn(names[i : i + LEARNED]) for i in range(0, len(names), LEARNED)]
        flat = np.concatenate([self.flat, *[ids for ids, _ in got]])
        ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *[n for _, n in got]]))])
        parts = np.zeros((len(words), 2), np.int64)  # place 0 is the empty word
        parts[:, 0] = at[: len(words)]
        parts[apart.to_numpy(zero_copy_only=False), 1] = at[len(words) :]
        size = np.diff(ends)
        if len(self.words) + len(names) <= KEPT_WORDS:
            self.words, self.flat, self.ends = pa.concat_arrays([self.words, new]), flat, ends
        at = parts.ravel()
        return flat[ranges(ends[at], size[at])], size[parts].sum(axis=1)


def encode(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, each closed by ``end_id``, and the bounds of the texts."""
    # the tokenizer lowers letters itself; doing it here for ASCII leaves fewer words. It looks for
    # its own tokens first, as they are written, so texts that may hold one stay as they are
    lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    words, ids, bounds = split(lower, ("\n",))
    flat, size = Encoder.of(path).encode(words)
    first = np.cumsum(size) - size
    per_word = size[ids]
    ends = np.concatenate(([0], np.cumsum(per_word)))[bounds]
    bounds = ends + np.arange(len(bounds))
    out = np.full(bounds[-1], end_id, np.uint32)
    inner = np.ones(len(out), bool)
    inner[bounds[1:] - 1] = False
    out[inner] = flat.take(ranges(first[ids], per_word))
    return out, bounds


class Packer:
    """Open windows of one partition; full pieces leave at once, rests go to the tightest window."""

    def __init__(self, length: int, windows: int, first: int):
        self.length, self.windows, self.next = length, windows, first
        self.fill, self.rows = np.zeros(windows, np.int64), [None] * windows  # free slots hold None
        self.out: list[tuple] = []
        self.bytes = 0

    def _emit(self, rows: list[tuple], is_open: bool) -> None:
        fill = sum(len(r[2]) // 4 for r in rows)
        at = 0
        for doc, start, ids, total in rows:
            self.out.append((doc, start, ids, total, self.next, at, is_open, fill))
            at += len(ids) // 4
            self.bytes += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.length
        data = ids.astype("<u4", copy=False).tobytes()
        for s in range(0, whole, self.length):
            self._emit([(doc, s, data[4 * s : 4 * (s + self.length)], n)], False)
        if whole == n:
            return
        rest, piece = n - whole, (doc, whole, data[4 * whole :], n)
        fits = self.fill + rest <= self.length
        used = np.array([r is not None for r in self.rows])
        if (fits & used).any():
            i = int(np.argmax(np.where(fits & used, self.fill, -1)))
        elif not used.all():
            i = int(np.argmin(used))
        else:
            i = int(np.argmax(self.fill))
            self._emit(self.rows[i], False)
            self.rows[i], self.fill[i] = None, 0
        self.rows[i] = [*(self.rows[i] or []), piece]
        self.fill[i] += rest
        if self.fill[i] == self.length:
            self._emit(self.rows[i], False)
            self.rows[i], self.fill[i] = None, 0

    def close(self) -> None:
        for r in self.rows:
            if r:
                self._emit(r, True)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) if self.out else [[]] * len(PIECE)
        self.out, self.bytes = [], 0
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, PIECE)], schema=PIECE)


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 4096,
    end_id: int = 2, windows: int = 64,
) -> DataFrame:
    """Pieces of sequences: doc_id, start, ids (binary, little-endian 32 bit), doc_tokens, sequence_id, offset.

    Each partition keeps ``windows`` open windows. A document's full pieces of
    ``length`` ids are sequences at once. The rest goes to the open window it fits
    best; if it fits none, the fullest is emitted. Windows still open at the end
    of the partitions are laid end to end and cut into full sequences; the last
    rest is cut into powers of two, which need no padding.

    Null or empty text: the end id alone. Rows of equal ids are packed each for
    itself. A null id stays null. No rows: none. Other columns play no part.
    """
    if length & (length - 1):
        raise ValueError("the length of a sequence is a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        give_back()
        packer = Packer(length, windows, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                ids, bounds = encode(part.column("text"), tokenizer_path, end_id)
                for doc, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    packer.add(doc, ids[a:b])
                    if packer.bytes > 8 << 20:
                        yield packer.take()
        packer.close()
        yield packer.take()
        give_back()

    by_value("surveyloom.llm.words", __name__)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with batches_of(docs.sparkSession, BATCH_ROWS):
        pieces = written(slim.mapInArrow(run, DDL), "pack-pieces")
    return pieces.where("not open").drop("open", "fill").unionByName(_merged(pieces.where("open"), length))


def _merged(open_: DataFrame, length: int) -> DataFrame:
    """Pieces of open windows laid end to end in the order of windows and cut anew."""
    per = open_.groupBy("sequence_id").agg(F.first("fill").alias("fill"))
    per = per.withColumn("part", F.shiftright("sequence_id", 33))
    laid = written(running_total(per, [], "part", ["sequence_id"], "fill", "base"), "pack-open").select("sequence_id", "base", "fill")
    total = laid.agg(F.max(F.col("base") + F.col("fill"))).first()[0] or 0
    full, rest = divmod(total, length)
    tail, at = [], full * length
    for bit in reversed(range(length.bit_length())):
        if rest >> bit & 1:
            tail.append((at, at + (1 << bit)))
            at += 1 << bit
    end = fresh(open_, "_end")
    rows = open_.join(laid.select("sequence_id", "base"), "sequence_id").withColumn("at", F.col("base") + F.col("offset"))
    rows = rows.withColumn(end, F.col("at") + F.expr("octet_length(ids) div 4"))
    cut = lambda a, b: F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
    last = F.array(*[cut(a, b) for a, b in tail]) if tail else F.array().cast("array<struct<a:bigint,b:bigint>>")
    first, final = F.floor(F.col("at") / length), F.floor((F.col(end) - 1) / length)
    spans = F.flatten(
        F.transform(
            F.sequence(first, final),
            lambda k: F.when(
                k < full,
                F.array(F.struct((k * length).cast("long").alias("a"), ((k + 1) * length).cast("long").alias("b"))),
            ).otherwise(last),
        )
    )
    rows = rows.withColumn("span", F.explode(spans)).where(
        (F.col("span.a") < F.col(end)) & (F.col("span.b") > F.col("at"))
    )
    lo, hi = F.greatest("at", "span.a"), F.least(end, "span.b")
    skip = (lo - F.col("at")).cast("int")
    return rows.select(
        "doc_id", (F.col("start") + skip).alias("start"),
        F.substring("ids", skip * 4 + 1, ((hi - lo) * 4).cast("int")).alias("ids"), "doc_tokens",
        (F.col("span.a") + F.lit(MERGED)).alias("sequence_id"), (lo - F.col("span.a")).alias("offset"),
    )


def digest(pieces: DataFrame, *more: str) -> DataFrame:
    """The result columns of the query, lengths and checksums in place of the ids, and ``more`` of the pieces."""
    return pieces.select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", *more,
    )
