"""URL filters, languages, personal data, line and sentence dedup."""

from __future__ import annotations

import itertools
import math
import os
import re
import sys
import time

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import helpers as H  # noqa: E402
from surveyloom.llm import language, line_dedup, pii, queries, sentence_spans, url_filters  # noqa: E402
from surveyloom.llm.common import numbered, running_total, table  # noqa: E402


def texts(spark, sf=H.SF):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


# ---- helpers


def test_running_total_and_numbers_equal_a_plain_scan(spark):
    df = spark.range(500).selectExpr("id", "if(id % 3 = 0, 'hot', concat('g', id % 5)) AS g", "id % 7 AS b", "id % 11 AS v")
    rows = sorted(df.collect(), key=lambda r: (r.g, r.b, r.id))
    want, total = {}, {}
    for r in rows:
        want[r.id] = total.get(r.g, 0)
        total[r.g] = want[r.id] + r.v
    assert {r.id: r.t for r in running_total(df, ["g"], "b", ["id"], "v", "t").collect()} == want
    places = {r.id: r.k for r in numbered(df, [df.v.desc(), df.id], "k", "test").collect()}
    assert [i for i, _ in sorted(places.items(), key=lambda x: x[1])] == [r.id for r in sorted(rows, key=lambda r: (-r.v, r.id))]
    assert sorted(places.values()) == list(range(500))


# ---- operator 1


def test_hosts_paths_and_rules(spark):
    urls = {
        1: ("HTTP://WWW.Example.ORG/es/a?x=1", "www.example.org", "/es/a", "example.org/es/", "block"),
        2: ("https://example.org:80/en/12#f", "example.org:80", "/en/12", None, None),
        3: ("https://example.org/en/12#f", "example.org", "/en/12", "example.org/en/1", "block"),
        4: ("x://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
        5: ("x://a.com/de/?u=y://b.org/", "a.com", "/de/", "com/de/", "block"),
        6: ("x://org?q", "org", "", None, None),
        7: ("no scheme/a", "", "", None, None),
        8: (None, "", "", None, None),
        9: ("", "", "", None, None),
        10: ("x://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        11: ("x://É.ORG/" + "a/" * 5000, "É.org", "/" + "a/" * 5000, "org/", "allow"),
    }
    df = spark.createDataFrame([(k, v[0], "x", 1) for k, v in urls.items()], "page_id long, url string, host string, tokens int")
    got = {r.page_id: r for r in url_filters.judge(df).collect()}
    assert len(got) == len(urls)
    for k, (_, host, path, rule, verdict) in urls.items():
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, rule), k
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
        assert r.tokens == 1
    assert url_filters.judge(df.where("false")).collect() == []


def test_rules_are_learned_from_labels(spark):
    rows = [("x://a.net/promo/%d" % i, "block") for i in range(50)] + [("x://a.net/news/%d" % i, "allow") for i in range(50)]
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    pages = spark.createDataFrame([(1, "x://b.net/promo/7"), (2, "x://b.net/news/7"), (3, "x://b.zz/")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.origin) for r in url_filters.judge(pages, labelled=labelled).collect()}
    assert got == {1: ("block", "mined"), 2: ("allow", "mined"), 3: ("allow", "default")}


# ---- operator 2


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    em, trans, first = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    ids, bounds = np.array([0, 3, 1, 5, 2, 2, 4]), np.array([0, 4, 4, 7])
    got, pairs = language.forward_backward(em, ids, bounds, trans, first, True)
    want, want_pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for a, b in ((0, 4), (4, 7)):
        chains = list(itertools.product(range(3), repeat=b - a))
        p = np.array([
            math.exp(first[c[0]] + sum(em[ids[a + i], s] for i, s in enumerate(c)) + sum(trans[x, y] for x, y in zip(c, c[1:])))
            for c in chains
        ])
        p /= p.sum()
        for c, w in zip(chains, p):
            for i, s in enumerate(c):
                want[a + i, s] += w
            for x, y in zip(c, c[1:]):
                want_pairs[x, y] += w
    assert np.abs(got - want).max() < 1e-5
    assert np.abs(pairs - want_pairs).max() < 1e-4


def test_held_out_documents_are_recognised(spark):
    rows = {r.doc_id: r for r in queries.op2_language(spark, H.SF).collect()}
    docs = table(spark, H.SF, "documents").collect()
    assert len(rows) == len(docs)
    out = [d for d in docs if rows[d.doc_id].held_out]
    assert 20 < len(out) < 80
    assert sum(rows[d.doc_id].lang_pred == d.lang for d in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_code_switched_text_is_labelled_word_by_word(spark):
    docs = table(spark, H.SF, "documents")
    model = language.train(docs)
    one, other = (docs.where(f"lang = '{x}' and length(text) > 300").orderBy("doc_id").first().text for x in ("de", "fr"))
    words = one.split()[:30] + other.split()[:30]
    em = language.emissions(language.features([w.lower().strip(".,") for w in words]), model.weights, len(words))
    got, _ = language.forward_backward(em, np.arange(60), np.array([0, 60]), model.transitions, model.first)
    best = [model.langs[i] for i in got.argmax(axis=1)]
    assert best[:28].count("de") >= 26 and best[32:].count("fr") >= 26


def test_language_hazards(spark):
    df = H.hazards(spark).withColumnRenamed("n", "score")
    model = language.train(table(spark, H.SF, "documents"))
    got = [(r.doc_id, r.text, r.lang_pred, r.score) for r in language.identify(df, model).collect()]
    assert len(got) == len(H.HAZARDS)
    for _, text, lang, score in got:
        if not re.search(r"[^\W\d_]", text or ""):
            assert (lang, score) == ("und", 0.0)
        else:
            assert lang in model.langs and 0 < score <= 1
    assert language.train(df.where("false")) is None
    assert {r.lang_pred for r in language.identify(df, None).collect()} == {"und"}
    assert language.identify(df.where("false"), model).collect() == []


def test_long_lines_are_cut_without_a_trace(spark):
    model = language.train(table(spark, H.SF, "documents"))
    rng = np.random.default_rng(5)
    em, ids = rng.normal(size=(50, len(model.langs))), rng.integers(0, 50, 5000)
    bounds = np.array([0, 3, 3, 4100, 4101, 5000])
    whole, _ = language.forward_backward(em, ids, bounds, model.transitions, model.first)
    assert np.abs(language.marginals(em, ids, bounds, model) - whole).max() < 1e-3


def test_languages_of_words_are_told_as_runs(spark):
    docs = table(spark, H.SF, "documents")
    model = language.train(docs)
    one, other = (docs.where(f"lang = '{x}' and length(text) > 300").orderBy("doc_id").first().text for x in ("de", "fr"))
    mixed = " ".join(one.split()[:30] + other.split()[:30])
    rows = [(1, mixed, 5), (2, None, 5), (3, "", 5), (4, " ".join([one] * 3000), 5)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, Lang_Runs int"), model).collect()}
    runs = got[1].lang_runs
    assert sum(r.words for r in runs) == 60 and [r.first for r in runs] == [0, *np.cumsum([r.words for r in runs])[:-1]]
    assert sum(r.words for r in runs if r.lang == "de" and r.first < 30) >= 26
    assert sum(r.words for r in runs if r.lang == "fr" and r.first >= 28) >= 26
    assert got[2].lang_runs == got[3].lang_runs == []
    assert got[4].lang_pred == "de" and sum(r.words for r in got[4].lang_runs) == len(one.split()) * 3000


def test_long_texts_of_one_language_leave_others_their_share(spark):
    docs = table(spark, H.SF, "documents").where("lang in ('de', 'fr')")
    de = " ".join(r.text for r in docs.where("lang = 'de'").collect())
    fr = [r.text for r in docs.where("lang = 'fr'").orderBy("doc_id").limit(8).collect()]
    rows = [(i, "de", de) for i in range(40)] + [(100 + i, "fr", t) for i, t in enumerate(fr)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    rest = docs.where("lang = 'fr'").orderBy(docs.doc_id.desc()).limit(10)
    assert [r.lang_pred for r in language.identify(rest, model).collect()].count("fr") >= 9


# ---- operator 3

ODD = [
    "a@b.com.x_foo@c.de ", "1.2.3.4.5.6.7.8 300.1.1.1", "x" * 20000, "1" * 30000, "a@b" + ".c" * 20000, "+1" + " " * 20000,
    "4111 1111 1111 1111 é +49 (0) 30-1234567", "é@x.de", "a@@b.c a@b..c.d", "", "4111-1111-1111-1111 5500-0000-0000-0004",
    "1.2.3.4@x.y.z", "00000001.2.3.4", "+" * 5000 + "1 234 567 890", "😀 mail me.x@y.zz\n😀 1.1.1.1", "%+-._@x.y", "1 2-3 4",
]


def test_base_spans_equal_a_plain_scan(spark):
    docs = texts(spark) + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    for d, t in docs:
        spans = H.base_spans(t)
        assert got[d].base_sha256 == H.span_hash(spans), (d, (t or "")[:80])
        assert [got[d][f"n_{k}"] for k in H.FORMS] == [sum(s[3] == k for s in spans) for k in H.FORMS]
        assert {f"{k}:{a}:{b}" for a, _, b, k in spans} <= set(got[d].spans.split(","))


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"please contact user{i}@mail.example.org now") for i in range(30)]
    rows += [(100, "please contact usr-99812 today"), (101, "about the year 2024-2025 nothing"), (102, "the code abc1234 in a text")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[100] == "learned:15:24"
    assert got[101] == "" and got[102] == ""
    assert got[0] == "email:15:37"


def test_contexts_find_identifiers_of_several_words_and_without_digits(spark):
    rows = [(i, f"please contact <{a}{b}@mail.example.org> now") for i, (a, b) in enumerate(itertools.product("abcde", "fghij"))]
    rows += [(100, "please contact (521) 555-6210 today"), (101, "do contact 5215 55 62, then 77"), (102, "may contact jane@intranet or so")]
    rows += [(103, "about (521) 555-6210 nothing"), (104, "about jane@home nothing"), (105, "contact 5 and 77, and 123"), (106, "contact a@b")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[0] == "email:16:35"
    assert got[100] == "learned:15:29" and got[101] == "learned:11:21" and got[102] == "learned:12:25"
    # the number is one wherever it stands, once a context has told it
    assert got[103] == "learned:6:20"
    assert got[104] == got[105] == got[106] == ""


def test_a_text_of_very_many_identifiers_is_no_square(spark):
    ips = [f"{i % 256}.{i // 256}.1.1" for i in range(50_000)]
    df = spark.createDataFrame([(1, " ".join(ips)), (2, "nothing here")], "doc_id long, text string")
    start = time.perf_counter()
    got = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    assert time.perf_counter() - start < 60
    spans = H.base_spans(" ".join(ips))
    assert got[1].n_ip == len(spans) and got[1].base_sha256 == H.span_hash(spans) and got[2].spans == ""


def scores_by_hand(pairs, seeds, rounds=3, least=3, score=0.8):
    """The instances that the graph of (pattern, instance) pairs finds, by plain scoring."""
    value = {i: float(i in seeds) for _, i in pairs}
    for _ in range(rounds):
        trust = {}
        for p in {p for p, _ in pairs}:
            own = [value[i] for q, i in pairs if q == p]
            if sum(v >= score for v in own) >= least and sum(own) / len(own) >= score:
                trust[p] = sum(own) / len(own)
        value = {
            i: 1.0 if i in seeds else round(1 - math.prod(max(1 - trust.get(p, 0), 1e-12) for p, j in pairs if j == i), 9) for i in value
        }
    return {i for i, v in value.items() if v >= score}


@pytest.mark.parametrize("seed", range(3))
def test_graph_scores_equal_plain_scoring(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = {(f"p{min(rng.integers(0, 6), rng.integers(0, 6))}", f"i{rng.integers(0, 40)}") for _ in range(150)}
    seeds = {f"i{i}" for i in range(33)}
    rows = [(p, i, i in seeds) for p, i in sorted(pairs)]
    got = {r.instance for r in pii.bootstrap(spark.createDataFrame(rows, "pattern string, instance string, seed boolean")).collect()}
    assert got == scores_by_hand(pairs, seeds) and got - seeds


def test_pii_hazards(spark):
    df = H.hazards(spark)
    rows = pii.digest(pii.find(df)).collect()
    assert len(rows) == len(H.HAZARDS)
    assert sum(r.n_email for r in rows) == 1
    assert pii.find(df.where("false")).collect() == []


# ---- operators 4 and 6


def lines_by_hand(docs):
    return H.without_later_runs(docs, lambda t: t.split("\n"), lambda x: x.strip(" "), 3, any, "\n")


def sentences_by_hand(docs, n=2, least=12):
    def cut(t):
        return re.split(r"(?<=[.!?]\s)|(?<=\n)", t)

    def enough(run):
        return sum(x.count(" ") + 1 for x in run) >= least

    return H.without_later_runs(docs, cut, lambda x: x.strip(" \t\r\n"), n, enough, "")


def test_lines_equal_a_plain_scan(spark):
    docs = texts(spark)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in queries.op4_line_dedup(spark, H.SF).collect()}
    assert got == lines_by_hand(docs)
    assert sum(v[2] for v in got.values()) > 100


def test_overlapping_windows_go_as_one_and_blank_ones_stay(spark):
    docs = [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd\ny"), (3, "b\nc\nd"), (4, "\n\n\n\n"), (5, "\n\n\n"), (6, " a\nb \nc"), (7, "a\nb")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {
        1: ("a\nb\nc\nd\ne", 0), 2: ("x\ny", 4), 3: ("", 3), 4: ("\n\n\n\n", 0), 5: ("\n\n\n", 0), 6: ("", 3), 7: ("a\nb", 0),
    }


@pytest.mark.parametrize("cut", [line_dedup.dedup_lines, sentence_spans.dedup_spans])
def test_window_hazards(spark, cut):
    df = H.hazards(spark)
    out = cut(df)
    assert out.columns[: len(df.columns)] == df.columns
    rows = out.collect()
    assert len(rows) == len(H.HAZARDS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text is None and by[2][0].text == "" and by[4][0].text == H.LONG
    assert len({tuple(map(str, r)) for r in by[6]}) == 1  # rows equal in id and text fare alike
    assert by[5][0].n_removed == 0
    assert cut(df.where("false")).collect() == []
    if cut is line_dedup.dedup_lines:
        assert by[6][0].text == "other end"


@pytest.mark.parametrize("cut", [line_dedup.dedup_lines, sentence_spans.dedup_spans])
def test_columns_named_like_results_are_replaced(spark, cut):
    names = ("n_lines", "N_Removed", "n_sentences", "removed")
    df = spark.createDataFrame([(1, "a\nb\nc", *names), (2, "a\nb\nc", *names)], ["doc_id", "text", *names])
    out = cut(df)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert {r.doc_id for r in out.collect()} == {1, 2} and dict(out.dtypes)["n_removed"] == "bigint"


def test_sentence_spans_equal_a_plain_scan(spark):
    docs = texts(spark)
    got = {r.doc_id: (r.text, r.n_removed) for r in queries.op6_substring_dedup(spark, H.SF).collect()}
    want = {d: (t, n) for d, (t, _, n) in sentences_by_hand(docs).items()}
    assert got == want
    assert sum(v[1] for v in got.values()) > 50


def test_long_shared_passages_are_cut_from_later_texts(spark):
    passage = "The first shared sentence has quite some words in it. And a second one follows it right away here. The third ends it all with more words."
    docs = [(1, f"Own start of one. {passage} Own end."), (2, f"Another start here. {passage} Another end."), (3, "Clean text alone. With two sentences.")]
    got = {r.doc_id: (r.text, r.removed) for r in sentence_spans.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == (docs[0][1], []) and got[3] == (docs[2][1], [])
    assert got[2] == ("Another start here. Another end.", [1, 2, 3])
