import pytest
from pyspark.sql import functions as F

from surveyloom.functions import scales as S
from surveyloom.functions import text as X
from surveyloom.functions.money import bound_money, parse_money
from surveyloom.functions.words import stop_words


def apply(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}").repartition(3)
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


TOKENS = [
    ("This makes me feel calm", ["thi", "mak", "feel", "calm"]),
    ("It's blueberries & noodles", ["it'", "blueberry", "noodle"]),
    ("icecream ICE-cream", ["ice", "ice", "cream"]),
    ("dresses glass berries", ["dresse", "glass", "berry"]),
    ("123 !!! a", []),
    (None, ["missing"]),
    ("'' ''quoted'' n't yes ties", ["quoted", "yes", "tie"]),
    ("slowly ‘violins’", ["slow", "violin"]),
]


def test_tokenize(spark):
    assert apply(spark, [t for t, _ in TOKENS], X.tokenize) == [w for _, w in TOKENS]


def test_distinct_tokens_equal_tokens_without_repeats(spark):
    texts = [t for t, _ in TOKENS] + ["cat cats cat dog dogs", "berry berries"]
    distinct = apply(spark, texts, X.distinct_tokens)
    assert distinct == [list(dict.fromkeys(w)) for w in apply(spark, texts, X.tokenize)]


def test_missing_never_enters_a_vocabulary(spark):
    assert apply(spark, [None, "missing piece"], X.vocab_tokens) == [[], ["piece"]]


def test_normalize(spark):
    texts = [None, "  A  B \n–— C ", "　x y\x1cz "]
    assert apply(spark, texts, X.normalize_text) == ["", "a b -- c", "x y z"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("5 000 000", "5000000"), ("12345 678", "12345 678"), ("1 000 0000", "1000 0000"),
        ("1 234 567 8901", "1234567 8901"), ("1 2 345", "1 2345"), ("x1 000 y2 000", "x1000 y2000"),
        ("1" + " 000" * 40, "1" + "000" * 40),
    ],
)
def test_collapse_thousands(spark, text, want):
    assert apply(spark, [text], X.collapse_spaced_thousands) == [want]


def test_flags(spark):
    assert apply(spark, ["i am not sure", "surely", "idk!"], X.looks_uncertain) == [True, False, True]
    zero = ["10,000", "200.0", "5000", "zero", "freedom", "for free", "0"]
    assert apply(spark, zero, X.looks_zero) == [True, True, False, True, False, True, True]
    strict = apply(spark, zero, lambda c: X.looks_zero(c, strict=True))
    assert strict == [False, False, False, True, False, True, True]
    # letters beyond ASCII are letters: no word bound before the zero
    assert apply(spark, ["é0"], X.looks_zero) == [False]


def test_multiselect(spark):
    cells = ["A, B ,,missing", "Missing", None, " ", "a"]
    assert apply(spark, cells, X.split_multiselect) == [["A", "B"], [], [], [], ["a"]]


def test_stop_words():
    assert len(stop_words()) == len(set(stop_words())) == 353
    assert list(stop_words()) == sorted(stop_words())


def test_phrases_with_optional_starts_and_alternatives(spark):
    patterns = [r"\bs?he\b", r"\bfoo\b|\bbar\b"]
    texts = ["he", "she", "the", "a bar", "foo", "food", "é he", "éhe"]
    got = apply(spark, texts, lambda c: X.contains_any(c, patterns))
    assert got == [True, True, False, True, True, False, True, False]


MONEY = [
    ("200", 200), ("2,500", 2500), ("10,000", 0), ("200.0", 0), ("$100.00", 0), ("0.5", 0),
    ("10 000", 10000), ("$5 000 000", 5e6), ("12345 678", 12345), ("1.5k", 1500), ("7b", 7e9),
    ("$5 million", 5e6), ("5million", None), ("99m", None), ("-50", 50), ("5 bucks", 5),
    ("$5 bucks", 5e9), ("$20 because", 2e10), ("20$", 20), ("3-4 dollars", 4),
    ("about 300 or 400", 400), ("depends, 300 or 400, hmm 350", 350),
    ("if i were rich 500 but 111 now", 111), ("max 55, maybe 211", 211), ("free", 0), ("nothing", 0),
    ("zero", 0), ("no money", 0), ("not sure", None), ("idk", None), ("depends maybe idk", None),
    ("", None), ("nan", None), ("N/A", None), ("na", None), ("none", None), (None, None),
    ("$999999999999999999999999999999999999", 1e36),
    ("i would pay 20 and then a long tale that says nothin more of it until 500 comes up", 20),
]


def test_money_table(spark):
    got = apply(spark, [t for t, _ in MONEY], parse_money)
    assert dict(zip([t for t, _ in MONEY], got)) == {t: None if v is None else float(v) for t, v in MONEY}


def test_money_strict_zero(spark):
    got = apply(spark, ["10,000", "200.0", "0", "0 dollars"], lambda c: parse_money(c, strict_zero=True))
    assert got == [10000.0, 200.0, 0.0, 0.0]


def test_money_bounds(spark):
    assert apply(spark, [None, -1.0, 5.0, 1e36], bound_money, "double") == [None, 0.0, 5.0, 324e6]


def test_numbers(spark):
    texts = ["1", " 2.5 ", "1e3", ".5", "5.", "1d", "1f", "x", "nan", "inf", "-Infinity", None, "1_000"]
    got = apply(spark, texts, S.to_number)
    inf = float("inf")
    assert got == [1, 2.5, 1000, 0.5, 5, None, None, None, None, inf, -inf, None, None]
    assert apply(spark, [inf, -inf, 1.0], S.finite, "double") == [None, None, 1.0]


def test_rounding_and_bounds(spark):
    assert apply(spark, [0.5, 1.5, 2.5, -1.0, 99.0], lambda c: S.to_count(c, 20), "double") == [0, 2, 2, 0, 20]
    assert apply(spark, [0.0, 1.0, 10.0, 11.0], lambda c: S.bounded(c, 1, 10), "double") == [None, 1, 10, None]
    got = apply(spark, [1e30, -1e30, 2.5, float("inf")], S.to_long, "double")
    assert got == [9223372036854774784, -9223372036854774784, 2, None]


def test_lookup(spark):
    assert apply(spark, [" a ", "b", None, "c"], lambda c: S.label_id(c, {"a": 0, "b": 1})) == [0, 1, None, None]
    assert apply(spark, [0, 1, 9, None], lambda c: S.label_title(c, {0: "x", 1: "y"}), "int") == ["x", "y", None, None]
