"""Words of Arrow text batches: split and numbered in Arrow, so that work is done once per distinct word."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20
SLICE_ROWS = 20_000


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``most`` bytes of text; one row at least, SLICE_ROWS at most."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(size, dtype=np.int64), 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        end = min(end, start + SLICE_ROWS)
        yield batch.slice(start, end - start)
        start = end


def split(texts: pa.Array, breaks: tuple[str, ...] = ("\n", "\t", "\r")) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in order, first word of each text and the end).

    Words are what stands between spaces and ``breaks``; null texts have none.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for c in breaks:
        texts = pc.replace_substring(texts, c, " ")
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
    words = coded.dictionary
    # runs of spaces give empty words: leave them out
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    if blank >= 0:
        there = ids != blank  # the blank entry stays in the dictionary
        ends = np.concatenate(([0], np.cumsum(there)))
        return words, ids[there], ends[offsets]
    return words, ids, offsets


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges [start, start + length), one range after the other."""
    total = int(lengths.sum())
    kind = np.int32 if total + int(starts.max(initial=0)) < 1 << 31 else np.int64
    shift = np.cumsum(lengths) - lengths
    out = np.repeat((starts - shift).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def give_back() -> None:
    """Hands memory that this worker's earlier tasks left unused back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """``run`` over the batches of a task, then :func:`give_back`: workers wait for later stages without its memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def let_go() -> None:
    """Drops the tokenizers and words that earlier tasks of other operators kept in this worker."""
    sys.modules.pop("surveyloom_worker_store", None)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of rows [bounds[i], bounds[i + 1]) along the first axis."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]
