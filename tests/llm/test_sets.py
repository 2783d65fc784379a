"""Near-duplicates, search, mixing, packing and the pipeline."""

from __future__ import annotations

import os
import sys
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
import helpers as H  # noqa: E402
from surveyloom.llm import bag_minhash, grid_order, mixing, packing, queries, topk  # noqa: E402
from surveyloom.llm.common import table  # noqa: E402
from surveyloom.llm.components import components  # noqa: E402
from surveyloom.llm.words import giving_back, let_go  # noqa: E402

NAN, INF = float("nan"), float("inf")


def texts(spark, sf=H.SF):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(201, 202), (202, 203), (203, 201), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {201: 201, 202: 201, 203: 201}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- operator 5


def test_values_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    miss = []
    for _ in range(40):
        n = int(rng.integers(3, 200))
        h = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        a = rng.integers(0, 9, len(h))
        b = np.where(rng.random(len(h)) < 0.8, a, rng.integers(0, 9, len(h)))
        value = [bag_minhash.signatures(np.zeros((c > 0).sum(), int), h[c > 0], c[c > 0], 1, 2048) for c in (a, b)]
        if max(a.max(), b.max()):
            miss.append((value[0] == value[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(miss)) < 0.004 and np.abs(miss).max() < 0.06


def test_near_classes_equal_brute_force(spark):
    docs = texts(spark)
    want = H.classes([d for d, _ in docs], H.near_links(docs))
    got = {r.doc_id: (r.class_id, r.kept) for r in queries.op5_minhash_near_dedup(spark, H.SF).collect()}
    assert {d: c for d, (c, _) in got.items()} == want
    assert all(kept == (c == d) for d, (c, kept) in got.items())
    assert sum(c != d for d, c in want.items()) > 5


def test_large_groups_of_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(base[:150] + [f"own{i}"] + base[150:])) for i in range(60)]
    docs += [(100 + i, " ".join(f"q{(i * 37 + j) % 5000}" for j in range(150))) for i in range(30)]
    docs += [(200 + i, "the very same text of some words") for i in range(50)]
    docs += [(300, "few words"), (301, "few words"), (302, "few words more")]
    got = {r.doc_id: r.class_id for r in bag_minhash.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == H.classes([d for d, _ in docs], H.near_links(docs))
    assert {got[i] for i in range(60)} == {0} and {got[200 + i] for i in range(50)} == {200} and got[301] == 300 and got[302] == 302


def test_links_of_every_text_of_a_repeated_id(spark):
    base = [[f"{c}{i}" for i in range(80)] for c in "pqr"]
    near = lambda k, *own: " ".join(base[k][:60] + list(own) + base[k][60:])
    docs = [(1, near(0)), (1, near(1)), (2, near(0, "x")), (3, near(1, "y")), (4, near(2)), (4, near(2)), (5, near(2, "z"))]
    got = sorted(tuple(r) for r in bag_minhash.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted([(1, 1, True)] * 2 + [(2, 1, False), (3, 1, False)] + [(4, 4, True)] * 2 + [(5, 4, False)])


def test_few_links_in_a_large_group_are_all_found(spark):
    # pairs of copies (similarity 0.97) in one family whose other pairs lie around 0.74
    rng = np.random.default_rng(5)
    docs = []
    for k in range(400):
        words = [f"w{i}" for i in range(400)]
        for i in rng.choice(np.arange(2, 395, 6), 7, replace=False):
            docs.append((2 * k, " ".join(words)))
            words[i] = f"own{k}x{i}"
        docs[-7:] = [docs[-1], (2 * k + 1, " ".join(words))]
    got = {r.doc_id: r.class_id for r in bag_minhash.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    runs = [{tuple(w[i : i + 5]) for i in range(396)} for _, t in docs for w in [t.split()]]
    assert {len(r) for r in runs} == {396}  # no run twice
    place = {r: i for i, r in enumerate(set().union(*runs))}
    has = np.zeros((len(docs), len(place)), np.float32)
    for row, r in zip(has, runs):
        row[[place[x] for x in r]] = 1
    both = has @ has.T
    a, b = np.nonzero(both >= 0.8 * (792 - both) - 1e-9)
    want = H.classes([d for d, _ in docs], [(docs[i][0], docs[j][0]) for i, j in zip(a, b) if i < j])
    assert got == want and 200 < len(set(want.values())) <= 400


def test_near_hazards(spark):
    df = H.hazards(spark)
    rows = bag_minhash.near_classes(df).collect()
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in rows), key=H.key)
    want = [(d, d, True) for d in (None, None, 1, 2, 3, 4, 5, 6, 6, 7)]
    assert got == sorted(want, key=H.key)
    assert bag_minhash.near_classes(df.where("false")).collect() == []


# ---- operators 7 and 8


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + 0.25 * rng.normal(size=8)).tolist(), i % 3) for i in range(300)]
    rows += [(300 + i, rows[7][1], 1) for i in range(40)] + [(400, rows[7][1], None)]
    rows += [(500, None, 1), (501, [None] + [0.5] * 7, 1), (502, [NAN] + [0.5] * 7, 1), (503, [INF] * 8, 1), (504, [0.0] * 8, 1)]
    rows += [(550, [], 1), (560, [1.0, 2.0], 1), (570, [-x for x in rows[0][1]], 0), (None, [1.0] * 8, 1), (7, rows[7][1], 1)]
    return rows


def table_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.selectExpr("*", "1 AS node", "'x' AS block", "2 AS id")


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def padded(v):
    return np.array(list(v) + [0.0] * (8 - len(v)))


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "CHUNK", 16)
    rows = vectors()
    good = [(i, np.floor(256 * padded(v)).astype(int)) for i, v, _ in rows if usable(v) and i is not None]
    want = []
    for q, a in good:
        if q % 10 == 0:
            best = sorted(((-int(a @ b), i) for i, b in good if i != q))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    df = table_of(spark, rows)
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 10 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want)


def test_search_of_little(spark):
    df = table_of(spark, [(0, [1.0], 1), (1, [2.0], 1), (2, [-1.0], 1)])
    assert sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id = 0")).collect()) == [(0, 1, 1, 131072), (0, 2, 2, -65536)]
    assert topk.top_k(df.where("false"), df).collect() == []
    assert topk.top_k(df, df.where("false")).collect() == []
    none = table_of(spark, [(0, [], 1), (1, [], 1), (2, [], 1)])
    assert sorted(tuple(r) for r in topk.top_k(none, none.where("vec_id = 1")).collect()) == [(1, 1, 0, 0), (1, 2, 2, 0)]


def small_search(monkeypatch, **sizes):
    for name, value in ({"BLOCK": 3, "CHUNK": 16} | sizes).items():
        monkeypatch.setattr(topk, name, value)


def test_search_broadcasts_no_copies_of_queries(spark, monkeypatch):
    small_search(monkeypatch)
    df = table_of(spark, vectors())
    plan = topk.top_k(df, df.where("vec_id % 10 = 0"), 5)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    sent = [i for i, x in enumerate(plan) if "BroadcastExchange" in x]
    assert any("Generate" in x for x in plan)
    for i in sent:
        end = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
        assert not any("Generate" in x for x in plan[i:end])


@pytest.mark.parametrize("sizes", [{"HELD": 512, "RUNS": 3, "TASKS": 4}, {"HELD": 4096, "RUNS": 1, "PAIRS": 2000}, {"MOST_BYTES": 128}])
def test_search_in_groups_and_runs_equals_brute_force(spark, monkeypatch, sizes):
    small_search(monkeypatch, **sizes)
    rng = np.random.default_rng(6)
    rows = [(i, (v * 10.0 ** rng.integers(-2, 3)).tolist(), 0) for i, v in enumerate(rng.normal(size=(400, 8)))]
    rows += [(400 + i, rows[30][1], 0) for i in range(30)] + [(20, rows[20][1], 0), (30, rows[30][1], 0)]
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows]
    want = []
    for q, a in good:
        if q % 10 == 0:
            best = sorted((-int(a @ b), i) for i, b in good if i != q)[:7]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    df = table_of(spark, rows)
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 10 = 0"), 7).collect()]
    assert sorted(got) == sorted(want)


def test_queries_that_need_like_chunks_are_held_together():
    of, ends = topk.dealt({9: 5, 7: 25, 4: 2, 3: 3, 1: 4}, 10)
    assert of == {9: (0, 1), 7: (1, 3), 4: (4, 1), 3: (4, 1), 1: (4, 1)}
    assert ends == [9, 7, 7, 7, 4]


@pytest.mark.parametrize("block", [5, 1024])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(grid_order, "BLOCK", block)
    monkeypatch.setattr(grid_order, "LEAF", 4)
    rows = vectors()[:-1]
    unit = {i: (padded(v) / np.linalg.norm(padded(v)), y) for i, v, y in rows if usable(v) and any(v) and i is not None and y is not None}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][1] == unit[b][1] and unit[a][0] @ unit[b][0] >= 0.93]
    low, n = H.classes([i for i, _, _ in rows if i is not None], links), defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in grid_order.near_vectors(table_of(spark, rows)).collect()]
    want = [(i, n[i], low[i], low[i] == i) if i is not None else (None, 0, None, True) for i, _, _ in rows]
    assert sorted(got, key=H.key) == sorted(want, key=H.key)
    assert len(links) > 1000


def test_links_of_little(spark):
    df = table_of(spark, [(1, [1.0, 0.0], None), (2, None, 1)])
    assert sorted(tuple(r) for r in grid_order.near_vectors(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert grid_order.near_vectors(df.where("false")).collect() == []
    tiny = table_of(spark, [(1, [1e-200, 0.0], 1), (2, [1e200, 1e198], 1)])
    assert {r.n_links for r in grid_order.near_vectors(tiny).collect()} == {1}


# ---- operator 9


def test_mix_stays_near_its_targets(spark):
    rows = mixing.mix(table(spark, H.SF, "documents")).collect()
    total, by = sum(r.size for r in rows), defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * total) < 1e-6 * total
    for rs in by.values():
        assert rs[0].target <= 2 * rs[0].source_size + 1e-9
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 5
    again = mixing.mix(table(spark, H.SF, "documents").repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


@pytest.mark.parametrize("block", [1, 64, 4096])
def test_mix_gives_small_sources_their_targets(spark, block):
    rows = [(i, "word " * 500, "big") for i in range(40)] + [(100 + i, "few " * 10, f"s{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = defaultdict(list)
    for r in mixing.mix(df, block=block).collect():
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    assert len(by) == 21
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 0.5
    assert all(r.taken == 20 for s, rs in by.items() if s != "big" for r in rs)


def test_schedule_gives_each_source_its_slots_evenly(spark):
    df = spark.createDataFrame([(i, "w " * (400 + 600 * (i % 3 == 0)), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    targets = mixing.source_targets(mixing.sized(df), block=16)
    want = {r.no: r.slots for r in targets.collect()}
    rows = sorted((r.slot, r.no, r["rank"]) for r in mixing.schedule(targets).collect())
    assert len({s for s, _, _ in rows}) == len(rows) == sum(want.values())
    for no, n in want.items():
        own = [(s, k) for s, x, k in rows if x == no]
        assert [k for _, k in own] == list(range(n))
        # any prefix of the schedule holds the source in its share, but for a few slots
        assert max(abs(k - s * n / len(rows)) for s, k in own) < 8


def test_mixing_stage_keeps_small_sources_of_large_corpora(spark):
    rows = [(i, "word " * 20_000, "en", "big", 100_000) for i in range(120)]
    rows += [(1000 + i, "few", "en", f"small{i}", 3) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = defaultdict(int)
    for r in dict(corpus_pipeline.STAGES)["source_mixing"](spark, docs, H.SF).select("source").collect():
        got[r.source] += 1
    assert {s: n for s, n in got.items() if s != "big"} == {f"small{i}": 2 for i in range(20)}


def test_near_copy_stage_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (5, text), (6, text + " end"), (None, "no id here"), (None, "no id here"), (None, "other words"), (7, "one"), (7, "two")]
    rows += [(9, None), (9, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, docs, H.SF).select("doc_id", "text").collect()
    want = [(5, text), (None, "no id here"), (None, "other words"), (7, "one"), (7, "two"), (9, None), (8, "")]
    assert sorted(map(tuple, got), key=H.key) == sorted(want, key=H.key)


def test_mix_hazards(spark):
    df = H.hazards(spark)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(H.HAZARDS)
    assert {r.source for r in rows if r.source_size == 0} <= {None}
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix(df.where("false")).collect() == []
    nothing = mixing.mix(df.where("text is null")).collect()
    assert len(nothing) == 2 and all((r.target, r.taken) == (0.0, 0) for r in nothing)
    out = mixing.repeated(df, mixing.mix(df))
    assert out.columns == df.columns and 0 < out.count() <= 2 * len(H.HAZARDS)


# ---- operator 10


def test_ids_of_the_tokenizers_own_tokens(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_path())
    forms = [f"<|{w}|>" for t in ("startoftext", "endoftext") for w in (t, t.upper(), t.capitalize(), t[:5] + " " + t[5:])]
    texts = forms + [f"Some{f}Words {f}. End{f}" for f in forms] + ["<| The END |>", "A<|b|>C plain WORDS."]
    for t in texts:
        ids, bounds = packing.encode(pa.array([t]), queries.tokenizer_path(), 2)
        assert ids.tolist() == [*model.encode(t, add_special_tokens=False).ids, 2], t
        assert bounds.tolist() == [0, len(ids)]


def round_trip(docs, rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_path())
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for d, t in docs:
        ids, at = [*model.encode(t or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)), d
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()), d
            at += r.length
        assert at == len(ids), d
    pad = full = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 4096
        full += at
        pad += 4096 - at if at & (at - 1) else 0
    assert pad <= 0.02 * (pad + full)


def test_every_id_lies_in_one_piece(spark):
    round_trip(texts(spark), queries.op10_packing(spark, H.SF).collect())


def test_packing_hazards(spark):
    odd = [
        "", None, "a\tb c\u00a0d\u2003e\n\n\x1cf\x85g", "<|endoftext|> x<|startoftext|>y it's DON'T 12 ab34 ́e é ΑΣ Σ!!", " ", "x" * 50000,
        "w " * 30000, "日本語 テキスト 😀😀 naïve \r\n a\x00b", "end. End.. end?! (end.) 'tis. I'm. x's. é. 5.", "a" * 4095, "K. ſ. İ. ı.",
    ]
    docs = list(enumerate(odd))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for parts in (1, 5):
        round_trip(docs, packing.digest(packing.pack(df.repartition(parts), queries.tokenizer_path())).collect())
    rows = packing.pack(H.hazards(spark), queries.tokenizer_path()).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in H.HAZARDS}
    assert packing.pack(df.where("false"), queries.tokenizer_path()).collect() == []


# ---- the pipeline


def test_stages_do_what_they_say(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "source_mixing", "packing"]
    docs = table(spark, H.SF, "documents")
    junk = spark.createDataFrame([(-1, "12 34 !!", "en", "src0", 8), (-2, None, "en", "src0", None), (-3, "", None, None, 0)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, docs.union(junk), H.SF)
    assert {r.doc_id for r in told.collect()} == {r.doc_id for r in docs.collect()}
    cut = stages["line_dedup"](spark, docs, H.SF)
    want = H.without_later_runs(texts(spark), lambda t: t.split("\n"), lambda x: x.strip(" "), 3, any, "\n")
    assert {r.doc_id: r.text for r in cut.collect()} == {d: t for d, (t, n, gone) in want.items() if not gone or gone < n}
    one = stages["minhash_near_dedup"](spark, docs, H.SF)
    low = H.classes([d for d, _ in texts(spark)], H.near_links(texts(spark)))
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, c in low.items() if c == d)
    mixed = stages["source_mixing"](spark, docs, H.SF)
    assert [told.columns, cut.columns, one.columns, mixed.columns] == [docs.columns] * 4
    round_trip(texts(spark), stages["packing"](spark, docs, H.SF).collect())


def test_pipeline_of_hazards_and_nothing(spark):
    for docs in (H.hazards(spark), H.hazards(spark).where("false")):
        docs = docs.select(*corpus_pipeline.COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, H.SF)
        docs.collect()


def test_words_encoded_together_keep_their_own_ids():
    words = ["cóté", "́x", "naïve", "it's", "don't'", "<|endoftext|>a", " ", "x ", "한국", "한", "🙂🙂", "12a3", "--", "ß.", "end.", "END!?", "a<|b."]
    words += [f"w{i}{chr(97 + i % 26) * (i % 7)}" for i in range(3 * packing.JOINED)]
    encoder = packing.Encoder(queries.tokenizer_path())
    alone = [encoder.model.encode(w, add_special_tokens=False).ids for w in words]
    calls, model = [], encoder.model

    class Counted:
        def encode_batch(self, lines, **how):
            calls.extend(lines)
            return model.encode_batch(lines, **how)

    encoder.model = Counted()
    for _ in range(2):
        flat, size = encoder.encode(pa.array(words))
        assert [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])] == alone
    assert len(calls) <= 5


def test_labelling_lets_go_of_kept_words():
    packing.Encoder.of(queries.tokenizer_path())
    let_go()
    assert "surveyloom_worker_store" not in sys.modules


def test_known_words_are_looked_up_without_python_strings():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x{i}" for i in range(20_000)]
    array = pa.array([w + "." * (i % 2) for i, w in enumerate(words)])
    encoder = packing.Encoder(queries.tokenizer_path())
    tracemalloc.start()
    try:
        first = encoder.encode(array)
        kept, _ = tracemalloc.get_traced_memory()
        tracemalloc.reset_peak()
        again = encoder.encode(array)
        peak = tracemalloc.get_traced_memory()[1] - kept
    finally:
        tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(first, again))
    ids = 4 * len(first[0])
    assert peak < 8 * ids + 100 * len(words)  # numbers alone
    assert kept < 4 * ids + 60 * len(words)


def test_words_beyond_those_kept_get_their_ids(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    encoder = packing.Encoder(queries.tokenizer_path())
    for words in (["a", "b."], ["c", "d!", "a", "e"], ["a.", "", "b", "c", "...", "d?.;"], [], ["a", "\u00e9."]):
        flat, size = encoder.encode(pa.array(words, pa.string()))
        alone = [encoder.model.encode(w, add_special_tokens=False).ids for w in words]
        assert flat.tolist() == [i for ids in alone for i in ids] and size.tolist() == [len(ids) for ids in alone]
        assert len(encoder.words) <= 3


def test_tasks_of_near_duplicates_give_their_memory_back(monkeypatch):
    from surveyloom.llm import words

    done = []
    monkeypatch.setattr(words, "give_back", lambda: done.append("back"))

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    def run(batches):
        yield from batches
        done.append("run")

    assert list(giving_back(run)([1, 2])) == [1, 2] and done == ["run", "back"]
    rows = pa.record_batch([pa.array([1], pa.int64()), pa.array(["one two three four five six"])], names=["id", "text"])
    for step in (bag_minhash._signed, bag_minhash._bagged):
        done.clear()
        assert sum(b.num_rows for b in step(Rows(), 5)([rows])) == 1 and done == ["back"]
