"""Operator 2: language of words and texts by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import by_value, fresh
from surveyloom.llm.words import give_back, let_go, ranges, slices, split, sums

UNKNOWN = "und"
BITS = 18
RUN = pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())])
RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("runs", pa.list_(RUN))])
# Longer lines are cut into chains of so many words, each read with some words more on both sides:
# what is further away than those does not reach a word's probabilities.
CHAIN = 400
# text labelled at once; its marginals take some hundred times as much
TEXT_BYTES = 1 << 20
OVERLAP = 40
# around words, not part of them
_MARKS = ".,!?;:|\"'()[]{}*#%$&<>=+-_/\\~^`«»“”„…"


@dataclass
class Model:
    """Languages, weights of hashed features (rows), of transitions and of the first word."""

    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) pairs of distinct words.

    A word stands between marks for its ends; features are its 1-, 2- and 3-grams
    (those at the ends are affixes), the affixes of three letters, and the word
    itself, whose weight is its entry in the learned lexicon.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    framed = "\x02" + "\x03\x02".join(words) + "\x03"
    code = np.frombuffer(framed.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    left = np.repeat(first + size, size) - np.arange(len(code))  # characters from here to the end
    out_word, out = [], []

    def add(which: np.ndarray, h: np.ndarray, kind: int) -> None:
        h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out_word.append(which)
        out.append((h >> np.uint64(64 - BITS)).astype(np.int64))

    h = code.copy()
    add(word, h, 1)
    for n in (2, 3):
        h = h[:-1] * np.uint64(1_000_003) + code[n - 1 :]
        ok = left[: len(h)] >= n
        add(word[: len(h)][ok], h[ok], n)
    h = h[:-1] * np.uint64(1_000_003) + code[3:]
    at_start, at_end = first[size >= 4], (first + size - 4)[size >= 4]
    add(np.flatnonzero(size >= 4), h[at_start], 4)
    add(np.flatnonzero(size >= 4), h[at_end], 5)
    place = np.arange(len(code)) - np.repeat(first, size)
    spread = (code * np.uint64(0x9E3779B97F4A7C15)) ^ (place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    spread *= spread | np.uint64(1)
    add(np.arange(len(words)), np.add.reduceat(spread, first), 6)
    return np.concatenate(out_word), np.concatenate(out)


def emissions(pairs: tuple[np.ndarray, np.ndarray], weights: np.ndarray, n: int) -> np.ndarray:
    word, feature = pairs
    w = weights[feature]
    return np.stack([np.bincount(word, w[:, k], n) for k in range(weights.shape[1])], axis=1)


def forward_backward(em, ids, bounds, transitions, first, want_pairs: bool = False):
    """Marginals (words, languages) of chains ids[bounds[i]:bounds[i + 1]], and expected transitions.

    All chains go forward together, the longest first, so a step is one product
    over those that are still on. Scaled at each step, in single precision.
    """
    k = em.shape[1]
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    n, start, size = len(ids), bounds[:-1][order], size[order]
    out, pairs = np.zeros((n, k), np.float32), np.zeros((k, k))
    if not len(order):
        return out, pairs
    longest = int(size[0])
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # chains with more than t words
    at = np.concatenate(([0], np.cumsum(active)))
    where = np.empty(n, np.int64)
    for t in range(longest):
        where[at[t] : at[t + 1]] = start[: active[t]] + t
    p = np.exp(np.maximum(em - em.max(axis=1, keepdims=True), -60)).astype(np.float32)
    tok = p[ids[where]]
    step = np.exp(transitions - transitions.max()).astype(np.float32)
    alpha = np.empty((n, k), np.float32)
    a = tok[: active[0]] * np.exp(first - first.max()).astype(np.float32)
    alpha[: active[0]] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, longest):
        m = active[t]
        a = (alpha[at[t - 1] : at[t - 1] + m] @ step) * tok[at[t] : at[t] + m]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at[t] : at[t] + m] = a
    back = np.ones((active[longest - 1], k), np.float32)
    for t in range(longest - 1, -1, -1):
        m, here = active[t], alpha[at[t] : at[t + 1]]
        if t < longest - 1:
            more = active[t + 1]
            ahead = tok[at[t + 1] : at[t + 2]] * back
            now = ahead @ step.T
            if want_pairs:
                z = (here[:more] * now).sum(axis=1, keepdims=True)
                pairs += step * (here[:more].T @ (ahead / z))
            now /= now.sum(axis=1, keepdims=True)
            back = np.ones((m, k), np.float32)
            back[:more] = now
        g = here * back
        out[where[at[t] : at[t + 1]]] = g / g.sum(axis=1, keepdims=True)
    return out, pairs


def fit(chunks: list[list[str]], labels: list[str], rounds: int = 40, rate: float = 0.5, penalty: float = 1e-3) -> Model:
    """Weights that make the labels likely, by AdaGrad over all chunks.

    A chunk has one label for all its words. Two chunks in a row make a chain, so
    that the transitions see changes of language.
    """
    langs = sorted(set(labels))
    of = {lang: i for i, lang in enumerate(langs)}
    k = len(langs)
    place: dict[str, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for c in chunks for w in c], np.int64)
    size = np.array([len(c) for c in chunks], np.int64)
    y = np.repeat([of[x] for x in labels], size)
    bounds = np.concatenate(([0], np.cumsum(size)))
    bounds = np.unique(np.append(bounds[::2], bounds[-1]))
    inner = np.ones(len(ids), bool)
    inner[bounds[:-1]] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    word, feature = features(list(place))
    used, feature = np.unique(feature, return_inverse=True)
    w, gw = np.zeros((len(used), k)), np.full((len(used), k), 1e-6)
    trans, gt = np.zeros((k, k)), np.full((k, k), 1e-6)
    first = np.zeros(k)
    hot = np.zeros((len(ids), k), np.float32)
    hot[np.arange(len(ids)), y] = 1
    n = len(ids)
    for _ in range(rounds):
        em = emissions((word, feature), w, len(place))
        got, pairs = forward_backward(em, ids, bounds, trans, first, True)
        miss = got - hot
        per_word = np.stack([np.bincount(ids, miss[:, j], len(place)) for j in range(k)], axis=1)
        g = np.stack([np.bincount(feature, per_word[word, j], len(used)) for j in range(k)], axis=1) / n + penalty * w / len(used)
        gw += g * g
        w -= rate * g / np.sqrt(gw)
        g = (pairs - seen) / n + penalty * trans / k
        gt += g * g
        trans -= rate * g / np.sqrt(gt)
    weights = np.zeros((1 << BITS, k), np.float32)
    weights[used] = w
    return Model(langs, weights, trans, first)


def clean(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), characters=_MARKS)


def train(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
    docs_per_lang: int = 400, chunk_words: int = 40, chunks_per_lang: int = 1000,
) -> Model | None:
    """A model from a bounded sample of labelled rows; None if no row is labelled.

    The sample is some ``docs_per_lang`` documents of each language by hash of the
    id, of these some ``chunks_per_lang`` runs of up to ``chunk_words`` words of each
    language by hash, so long texts of one language leave the others their share;
    only those words come to the driver. Rows without text or language teach nothing.
    """
    rows = docs.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id")
    ).where("lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    part = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) / 1_000_000
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, docs_per_lang / n))])
    some = rows.where("text is not null").where(part < share[F.col("lang")])
    words = F.filter(F.split("text", r"\s+"), lambda w: w.rlike(r"\p{L}"))
    some = some.select("lang", "id", words.alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    parts = F.transform(F.sequence(F.lit(0), n - 1, F.lit(chunk_words)), lambda i: F.slice("w", i + 1, F.lit(chunk_words)))
    runs = some.select("lang", "id", n.alias("n"), F.posexplode(parts).alias("pos", "chunk"))
    found = {r["lang"]: r["count"] for r in runs.groupBy("lang").count().collect()}
    if not found:
        return None
    place = F.pmod(F.xxhash64(F.lit("run"), "id", "pos"), F.lit(1_000_000)) / 1_000_000
    share = F.create_map(*[F.lit(x) for lang, n in found.items() for x in (lang, min(1.0, chunks_per_lang / n))])
    got = runs.where(place < share[F.col("lang")]).orderBy(F.xxhash64("id", "pos"), "id", "pos", "lang").collect()
    chunks = [clean(pa.array(r["chunk"])).to_pylist() for r in got]
    return fit(chunks, [r["lang"] for r in got]) if got else None


def marginals(em: np.ndarray, ids: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    """Marginals of the words of lines of any length, those above CHAIN words in overlapping chains."""
    size = np.diff(bounds)
    if size.max(initial=0) <= CHAIN:
        return forward_backward(em, ids, bounds, model.transitions, model.first)[0]
    chains = np.maximum(1, -(-size // CHAIN))
    line = np.repeat(np.arange(len(size)), chains)
    lo, hi = bounds[:-1][line], bounds[1:][line]
    start = lo + CHAIN * (np.arange(len(line)) - np.repeat(np.cumsum(chains) - chains, chains))
    end = np.minimum(start + CHAIN, hi)
    first, last = np.maximum(start - OVERLAP, lo), np.minimum(end + OVERLAP, hi)
    at = ranges(first, last - first)
    own = (at >= np.repeat(start, last - first)) & (at < np.repeat(end, last - first))
    wide = np.concatenate(([0], np.cumsum(last - first)))
    return forward_backward(em, ids[at], wide, model.transitions, model.first)[0][own]


def labelled_runs(got: np.ndarray, at: np.ndarray, langs: list[str]) -> pa.ListArray:
    """Runs (lang, first, words) of words of one most likely language, for each text; ``first`` counts from the text's start."""
    best = got.argmax(axis=1)
    new = np.ones(len(best), bool)
    new[1:] = best[1:] != best[:-1]
    new[at[:-1][np.diff(at) > 0]] = True
    start = np.flatnonzero(new)
    text = np.searchsorted(at, start, side="right") - 1
    size = np.diff(np.append(start, len(best)))
    runs = [pa.array(langs, pa.string()).take(pa.array(best[start])), pa.array(start - at[text]), pa.array(size)]
    ends = np.searchsorted(start, at).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(runs, fields=list(RUN)))


def predict(texts: pa.Array, model: Model) -> pa.StructArray:
    """(lang, score, runs) of each text: the language with the largest mean marginal over words with a letter, and the words' own."""
    lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    line_at = lines.offsets.to_numpy()
    words, ids, bounds = split(lines.flatten(), ("\t", "\r"))
    coded = clean(words).dictionary_encode()
    distinct, to = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    has_letter = pc.match_substring_regex(distinct, r"\p{L}").to_numpy(zero_copy_only=False)
    names = distinct.to_pylist()
    em = emissions(features(names), model.weights, len(names))
    ids = to[ids]
    got = marginals(em, ids, bounds, model)
    counted = has_letter[ids]
    at = bounds[line_at - line_at[0]]
    total = sums(got * counted[:, None], at)
    n = sums(counted.astype(np.float64), at)
    best = total.argmax(axis=1)
    score = np.where(n > 0, total[np.arange(len(best)), best] / np.maximum(n, 1), 0.0)
    names = np.array([*model.langs, UNKNOWN], object)[np.where(n > 0, best, len(model.langs))]
    runs = labelled_runs(got, at, model.langs)
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1)), runs], fields=list(RESULT))


def identify(
    docs: DataFrame, model: Model | None, text_col: str = "text", pred_col="lang_pred", score_col="score", runs_col="lang_runs"
) -> DataFrame:
    """All rows and columns of ``docs`` with the predicted language, its score and the languages of the words.

    Words are what white space parts; a line is a chain, cut above CHAIN words.
    The score is the mean probability of the language over the words that have a
    letter. ``runs_col`` tells the languages within the text: runs (lang, first,
    words) of consecutive words with the same most likely language. Null text,
    text without a letter, or no model: ``und`` with score 0; without words or
    model no runs. Equal texts get equal results. Whole texts are read, a slice of
    a batch at a time. Columns named like the results are replaced.
    """
    kind = "array<struct<lang: string, first: long, words: long>>"
    if model is None:
        return docs.withColumns({pred_col: F.lit(UNKNOWN), score_col: F.lit(0.0), runs_col: F.array().cast(kind)})
    by_value("surveyloom.llm.words", __name__)

    @F.arrow_udf(f"struct<lang: string, score: double, runs: {kind}>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        give_back()
        for texts in batches:
            rows = pa.record_batch([texts], names=["text"])
            parts = [predict(b.column("text"), model) for b in slices(rows, "text", TEXT_BYTES)]
            give_back()
            yield pa.chunked_array(parts, type=RESULT).combine_chunks()

    found = fresh(docs, "_found")
    out = docs.withColumn(found, judge(F.col(text_col)))
    new = {pred_col: F.col(found)["lang"], score_col: F.col(found)["score"], runs_col: F.col(found)["runs"]}
    return out.withColumns(new).drop(found)


def held_out(id_col: str = "doc_id"):
    """Documents whose crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
