"""Merkle manifest, quality rules and tokenizer alignment against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import helpers as H  # noqa: E402
from surveyloom.llm import alignment, merkle, quality, queries  # noqa: E402
from surveyloom.llm.common import table  # noqa: E402

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_corpus_queries_have_sql_but_for_those_named():
    # no SQL form; their own tests compare them with brute force
    none = {"op2_language", "op3_pii", "op5_minhash_near_dedup", "op6_substring_dedup", "op10_packing", "op13_cross_tokenizer_alignment"}
    assert set(queries.ALL) - set(queries.SQL) == none and set(queries.SQL) <= set(queries.ALL)


# ---- operator 11


def leaf(row):
    cell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(cell(row[k]) for k in merkle.FIELDS))


def rise(nodes, fanout):
    """(root, path of each node) of a plain tree."""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for r, run in enumerate(runs):
            for s in range(len(run)):
                for i in below[r * fanout + s]:
                    paths[i].append(("".join(run[:s]), "".join(run[s + 1 :])))
        below = [sum(below[i : i + fanout], []) for i in range(0, len(below), fanout)]
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], paths


def plain_manifest(rows, fanout=2):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, own = [], []
    for g in order:
        ls = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), leaf(r), i) for i, r in enumerate(groups[g]))
        root, paths = rise([x[1] for x in ls], fanout)
        subs.append(root)
        own.append([(groups[g][x[2]], x[1], p) for x, p in zip(ls, paths)])
    root, ups = rise(subs, fanout)
    for sub, up, rs in zip(subs, ups, own):
        for r, h, p in rs:
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                changed["n_chars"] += 1
            f = leaf(changed)
            for before, after in p + up:
                f = sha(before + f + after)
            yield (r["doc_id"], h, sub, root, sha("".join(a + b for a, b in p + up)), f, f == root)


def got_manifest(df):
    return sorted((tuple(r) for r in merkle.digest(df).collect()), key=H.key)


def test_manifest_of_hazards_equals_a_plain_tree(spark):
    df = H.hazards(spark)
    want = sorted(plain_manifest([r.asDict() for r in df.collect()]), key=H.key)
    assert got_manifest(df) == want
    assert got_manifest(df.where("doc_id < 0")) == []


def test_manifest_over_several_runs_of_levels(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPAN", 8)
    rows = [(i, f"text {i % 37}", ["en", "fr", None, "Ä", "é"][i % 97 % 5], "s", i if i % 5 else None) for i in range(301)]
    rows += [(7, "text 7", "en", "s", 7)] * 20 + [(900, "alone", "zz", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(plain_manifest([r.asDict() for r in df.collect()]), key=H.key)
    assert got_manifest(df) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


@pytest.mark.parametrize("fanout", [3, 5])
def test_manifest_of_other_fanouts(spark, fanout):
    rows = [(i, f"t{i}", "ab"[i > 70], "s", i) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {r[0]: (r[1], r[2], r[3]) for r in plain_manifest([r.asDict() for r in df.collect()], fanout)}
    m = merkle.manifest(df, fanout=fanout)
    got = m.select("*", merkle.fold(m["leaf"], m["path"]).alias("folded")).collect()
    assert {r.doc_id: (r.leaf, r.subroot, r.root) for r in got} == want
    assert all(r.folded == r.root for r in got)


# ---- operator 12


def plain_measures(text):
    text = text or ""
    space = " \t\n\x0b\x0c\r"
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(space)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    letters = [c for c in text if c.isalpha() and not c.isnumeric()]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(quality.SYMBOL, text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_ended_lines": sum(x.rstrip(space)[-1] in ".!?" for x in lines), "n_letters": len(letters),
        "n_capitals": sum(c.isupper() for c in letters), "n_ends": len(re.findall(r"[.!?](?=[\x20\x09-\x0D]|$)", text)),
        "n_distinct": len(set(w)),
    }


def check_measures(df):
    got = quality.measured(df).collect()
    want = sorted(((r.doc_id, plain_measures(r.text)) for r in df.collect()), key=lambda r: (str(r[0]), str(r[1])))
    have = sorted(((r.doc_id, {k: r[k] for k in quality.MEASURES}) for r in got), key=lambda r: (str(r[0]), str({k: r[1][k] for k in want[0][1]})))
    assert [(d, {k: m[k] for k in w}) for (d, m), (_, w) in zip(have, want)] == want


def test_measures_equal_plain_ones(spark):
    check_measures(table(spark, H.SF, "documents").select("doc_id", "text"))
    rows = [(0, "a a a a"), (1, "a b c a b c a b"), (2, "x\x0by\x0c z z q"), (3, "p q r s p q r t p q"), (4, "A. b?\n\nA. b?\nno"), (5, "ab")]
    check_measures(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("bits", [2, 62])
def test_windows_that_clash_or_have_no_number(spark, monkeypatch, bits):
    # few places, or hashes of two bits that agree for different windows
    monkeypatch.setattr(quality, "PLACE_BITS", bits)
    check_measures(table(spark, H.SF, "documents").select("doc_id", "text").where("doc_id < 60"))


def plain_em(patterns, names):
    share = lambda yes, of, x: min(quality.MOST, max(quality.LEAST, (yes + x * quality.STRENGTH) / (of + quality.STRENGTH)))
    start = quality.GOOD, quality.BAD
    prior, tables = quality.PRIOR, [dict.fromkeys(names, x) for x in start]

    def posterior(v):
        g, b = (w * math.prod(t[k][x + 1] for k, x in zip(names, v)) for w, t in zip((prior, 1 - prior), tables))
        return g / (g + b)

    for _ in range(quality.ROUNDS):
        p = {v: posterior(v) for v in patterns}
        weight = [{v: n * p[v] for v, n in patterns.items()}, {v: n * (1 - p[v]) for v, n in patterns.items()}]
        tables = [
            {k: tuple(share(sum(w[v] for v in w if v[i] == x), sum(w.values()), s[x + 1]) for x in (-1, 0, 1)) for i, k in enumerate(names)}
            for w, s in zip(weight, start)
        ]
        prior = share(sum(weight[0].values()), sum(patterns.values()), quality.PRIOR)
    return {v: posterior(v) for v in patterns}


def test_posteriors_equal_plain_em_and_agree_with_the_labels(spark):
    names = list(quality.RULES)
    out = quality.judge(table(spark, H.SF, "documents")).collect()
    votes = [(tuple(r[k] for k in names), r) for r in out if not r.base_failed]
    want = plain_em(Counter(v for v, _ in votes), names)
    assert max(abs(want[v] - r.quality) for v, r in votes) < 1e-5
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    out = quality.judge(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    right = [r.kept == bool(labels[r.doc_id]) for r in out if r.doc_id in labels and r.n_words >= 50]
    assert np.mean(right) > 0.99


def test_quality_of_hazards(spark):
    out = quality.judge(H.hazards(spark)).collect()
    assert len(out) == len(H.HAZARDS)
    for r in out:
        if r.doc_id in (1, 2, 3):
            assert (r.n_words, r.quality, r.base_failed, r.kept) == (0, 0.0, True, False)
    long_ = next(r for r in out if r.doc_id == 4)
    assert long_.n_words == 30_001 and long_.n_repeat_words == 30_000 and long_.base_failed and not long_.kept
    assert quality.judge(H.hazards(spark).where("doc_id < 0")).collect() == []


def test_text_full_of_one_word_takes_no_square_of_its_length(spark):
    rows = [(1, "word " * 300_000)]
    got = quality.measured(spark.createDataFrame(rows, "doc_id long, text string")).collect()[0]
    assert got.n_repeat_words == 300_000


# ---- operator 13


@pytest.fixture(scope="module")
def sides():
    return alignment.ByteLevel(A), alignment.Pieces(B)


def plain_alignment(text, sides):
    """(A ids, B ids, groups, links) by whole-text encoding and a scan of the bytes."""
    if not text:
        return [], [], [], []
    raw = f" {text}".encode()
    ids = [s.ids([text])[0] for s in sides]
    parts = [[s.bytes[i].as_py() for i in x] for s, x in zip(sides, ids)]
    if any(b"".join(p) != raw for p in parts):
        return [], [], [], []
    spans = []
    for p in parts:
        at = np.cumsum([0, *map(len, p)]).tolist()
        spans.append(list(zip(at, at[1:])))
    cuts = sorted({b for _, b in spans[0]} & {b for _, b in spans[1]})
    groups, low = [], 0
    for c in cuts:
        groups.append(tuple([i for i, (a, b) in zip(x, s) if low <= a and b <= c] for x, s in zip(ids, spans)))
        low = c
    links, j = [], 0
    for i, (a, b) in zip(ids[0], spans[0]):
        while spans[1][j][1] <= a:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < b:
            links.append((i, ids[1][k]))
            k += 1
    return ids[0], ids[1], groups, links


def plain_result(docs, sides):
    all_ = [(d, plain_alignment(t, sides)) for d, t in docs]
    count = Counter(p for _, x in all_ for p in set(x[3]))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    for d, (a, b, groups, links) in all_:
        name = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        yield (
            d, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
            sha(name) if a else "",
        )


ODD = [
    "plain words", " leading", "trailing ", "two  spaces", "   ", " ", "\n", "a\nb\n\n c", "tab\there", "<|endoftext|> </s><unk><s> <0x41>",
    "lower ▁ block", "Ünï cödé 漢字 😀 x", "é combining", "\x00 nul", "don't we'll 123 4,567.89", "x" * 3000, "a b c", "Ġ Ċ", "‍ zero",
]


def test_alignment_equals_a_plain_scan(spark, sides):
    docs = [(r.doc_id, r.text) for r in table(spark, H.SF, "documents").collect()]
    got = [tuple(r) for r in queries.op13_cross_tokenizer_alignment(spark, H.SF).collect()]
    assert sorted(got) == sorted(plain_result(docs, sides))


def test_alignment_of_odd_texts_in_many_slices(spark, sides, monkeypatch):
    docs = [(None, None), (1, None), (2, "")] + [(10 + i, t) for i, t in enumerate(ODD)] + [(10, ODD[0]), (None, "no id")]
    rng = np.random.default_rng(3)
    letters = list("abcE \n\t.,'1é漢▁ ß") + ["  ", "the ", "ing"]
    docs += [(100 + i, "".join(rng.choice(letters, int(rng.integers(1, 60))))) for i in range(300)]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, slice int, pairs int")
    monkeypatch.setattr(alignment, "TEXT_BYTES", 2000)
    monkeypatch.setattr(alignment, "KEPT_WORDS", 50)
    got = [tuple(r) for r in alignment.linked(df, A, B).collect()]
    assert sorted(got, key=H.key) == sorted(plain_result(docs, sides), key=H.key)
    assert any(g[1] for g in got) and sum(not g[1] for g in got) > 3
    assert alignment.linked(df.where("doc_id < 0"), A, B).collect() == []


def test_links_of_a_slice(sides):
    texts = ["some words of text", None, "other words"]
    ids = alignment.encode(texts, alignment.Words(A, B))
    per, links = alignment.align(ids, sides)
    assert per["n_links"].to_pylist() == [len(plain_alignment(t, sides)[3]) for t in texts]
    assert [tuple(r.values())[1:] for r in links.to_pylist()] == [p for t in texts for p in plain_alignment(t, sides)[3]]
    assert isinstance(ids[0], pa.LargeListArray) and math.isclose(per["n_a"][1].as_py(), 0)
