"""Operator 3: personal data by fixed forms and by bootstrapped contexts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import every, text_hash, written

# Fixed forms. Loops are possessive and starts are pinned, which finds the same
# leftmost matches without trying every start and without recursion on long runs.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*FORMS, "learned"]
# A word with a digit or an @, an identifier if it is long enough.
NUMBERED = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def _holds(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "card":
        def term(i: Column) -> Column:
            d = F.substr(digits, n - i, F.lit(1)).cast("int")
            twice = d * 2
            return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

        luhn = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + term(i))
        return F.when(n.between(12, 19), luhn % 10 == 0).otherwise(False)
    return F.lit(True)


def _valid(kind: str):
    return lambda span: _holds(kind, span["value"])


# Running sums are made in blocks of so many matches, so that no step copies more than a block or a value for each.
BLOCK = 128


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.lit(BLOCK)), lambda i: F.slice(items, i + 1, F.lit(BLOCK)))


def _placed(blocks: Column, kind: int) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        at = acc["at"] + F.length(m["piece"])
        end = at + F.length(m["value"])
        span = F.struct(at.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def ahead(acc: Column, block: Column) -> Column:
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def moved(block: Column, by: Column) -> Column:
        return F.transform(
            block["out"],
            lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["kind"].alias("kind"), s["value"].alias("value")),
        )

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return _let(
        F.transform(blocks, lambda b: F.aggregate(b, start, step)),
        lambda own: F.flatten(F.zip_with(own, F.aggregate(own, none, ahead)["out"], moved)),
    )


def located(found: Column, pieces: Column, kind: int) -> Column:
    """Array of (start, end, kind, value) in code points, end exclusive, of matches and the pieces before them."""
    pairs = F.arrays_zip(found.alias("value"), F.slice(pieces, F.lit(1), F.size(found)).alias("piece"))
    some = _let(pairs, lambda p: _let(_blocks(p), lambda b: _placed(b, kind)))
    return F.when(F.size(found) > 0, some).otherwise(F.array().cast(SPAN))


def starting_before(spans: Column, at: Column) -> Column:
    """How many of the spans, sorted by start, start before ``at``: found by halving."""
    n = F.size(spans)
    steps = F.transform(F.sequence(F.floor(F.log2(n)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))

    def step(k: Column, more: Column) -> Column:
        further = (k + more <= n) & (F.get(spans, k + more - 1)["start"] < at)
        return F.when(further, k + more).otherwise(k)

    return F.when(n > 0, F.aggregate(steps, F.lit(0), step)).otherwise(0)


def touched(spans: Column, start: Column, end: Column) -> Column:
    """Whether one of the spans, sorted and without overlap, shares a character with [start, end)."""
    last = F.get(spans, starting_before(spans, end) - 1)
    return F.coalesce(last["end"] > start, F.lit(False))


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, h, base, words, seeds): fixed-form spans of each text, its numbered words, and the spans again as seeds.

    Words (s, before, gap) have the word before and whether only spaces and
    brackets part them from the numbered word before; seeds (value, before).

    Every row of ``docs`` once, found by one pass over the whole texts.
    """
    t = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = t.withColumn("h", text_hash(F.col("t")))
    likely = {"email": F.instr("t", "@") > 0, "phone": F.instr("t", "+") > 0}
    digit = F.col("t").rlike("[0-9]")
    forms = {**FORMS, "word": NUMBERED}
    likely["word"] = digit | likely["email"]
    none = F.array().cast("array<string>")
    for kind, form in forms.items():
        found = F.regexp_extract_all("t", F.lit(form), F.lit(0))
        t = t.withColumn(f"m_{kind}", F.when(likely.get(kind, digit), found).otherwise(none))
    for kind, form in forms.items():
        some = F.size(f"m_{kind}") > 0
        t = t.withColumn(f"p_{kind}", F.when(some, F.split("t", form, -1)).otherwise(none))
    blank = lambda p: F.translate(p, "\n\t\r", "   ")
    end = lambda p: F.substring_index(p, " ", -1)
    last = lambda p: F.lower(end(F.rtrim(p)))
    # what stands before a match: the match before it and the piece between
    ahead = lambda kind: F.transform(
        f"p_{kind}", lambda p, i: blank(F.concat(F.coalesce(F.get(f"m_{kind}", i - 1), F.lit("")), p))
    )
    spans, seeds = [], []
    for i, kind in enumerate(FORMS):
        s = located(F.col(f"m_{kind}"), F.col(f"p_{kind}"), i)
        spans.append(F.filter(s, _valid(kind)))
        # a match may start within a word: the word before is the one before that word
        before = F.transform(ahead(kind), lambda p: last(F.substr(p, F.lit(1), F.length(p) - F.length(end(p)))))
        pairs = F.arrays_zip(F.col(f"m_{kind}").alias("value"), before.alias("before"))
        pairs = F.filter(pairs, lambda w: w["value"].isNotNull())
        seeds.append(F.filter(pairs, _valid(kind)))
    words = F.arrays_zip(
        located(F.col("m_word"), F.col("p_word"), len(KINDS) - 1).alias("s"),
        F.transform(ahead("word"), last).alias("before"),
        F.transform("p_word", lambda p: p.rlike(r"^ [\x20()\[\]]*$")).alias("gap"),
    )
    words = F.filter(words, lambda w: w["s"].isNotNull())
    return t.select(
        "doc", "h", F.array_sort(F.flatten(F.array(*spans))).alias("base"), words.alias("words"),
        F.flatten(F.array(*seeds)).alias("seeds"),
    )  # spans sort by start, end, kind; distinct kinds may share both


def occurrences(found: DataFrame, min_length: int = 6) -> DataFrame:
    """(doc, h, start, end, pattern, instance, seed) of all seeds and candidates.

    Seeds are the fixed-form spans. Candidates are numbered words that overlap
    none of them, words without a digit that have an @ inside, and runs of such
    numbered words with only spaces and brackets between, if they have
    ``min_length`` characters without punctuation around them. The pattern is the
    word before, whatever it is.
    """
    none = F.lit(None).cast("int")
    seeds = found.select("doc", "h", F.explode("seeds").alias("w")).select(
        "doc", "h", none.alias("start"), none.alias("end"), F.trim("w.before").alias("pattern"),
        F.col("w.value").alias("instance"), F.lit(True).alias("seed"),
    )
    numbered = lambda w: w["s"]["value"].rlike("[0-9]")
    kinds = [f"_b{i}" for i in range(len(FORMS))]  # spans of one kind have no overlap
    flagged = F.transform(
        "words",
        lambda w, i: F.struct(
            w["s"]["start"].alias("start"), w["s"]["end"].alias("end"), w["s"]["value"].alias("value"), w["before"].alias("before"),
            reduce(or_, [touched(F.col(b), w["s"]["start"], w["s"]["end"]) for b in kinds]).alias("base"),
            (w["gap"] & numbered(w)).alias("gap"), numbered(w).alias("numbered"),
        ),
    )
    own = lambda i: F.filter("base", lambda b: b["kind"] == i)
    w = found.where(F.size("words") > 0).select("doc", "h", "words", *[own(i).alias(b) for i, b in enumerate(kinds)])
    w = w.select("doc", "h", flagged.alias("words"))
    # a word goes on with the run of the one before it, unless that one ends in punctuation
    goes_on = lambda x, y: (
        y["gap"] & x["numbered"] & ~x["base"] & ~y["base"] & x["value"].rlike(r"[\p{L}\p{N})\]]$")
    )
    n = F.size("words")
    starts = F.filter(
        F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~F.coalesce(goes_on(F.get("words", i - 1), F.get("words", i)), F.lit(False))
    )
    w = w.select("doc", "h", "words", starts.alias("starts"))
    size = lambda b, i: F.coalesce(F.get("starts", i + 1), n) - b
    runs = F.filter(
        F.transform("starts", lambda b, i: F.slice("words", b + 1, size(b, i))), lambda r: F.size(r) > 1
    )
    runs = F.transform(
        runs,
        lambda r: F.struct(
            F.get(r, F.lit(0))["start"].alias("start"), F.element_at(r, -1)["end"].alias("end"),
            F.array_join(F.transform(r, lambda x: x["value"]), " ").alias("value"), F.get(r, F.lit(0))["before"].alias("before"),
            F.lit(True).alias("many"),
        ),
    )
    alone = F.transform(
        F.filter("words", lambda x: ~x["base"] & (x["numbered"] | x["value"].rlike("[^@]@[^@]"))),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["before"].alias("before"), F.lit(False).alias("many")),
    )
    w = w.select("doc", "h", F.explode(F.concat(alone, runs)).alias("w"))
    # a bracket that closes before more of the run belongs to it
    own = r"^[^\p{L}\p{N}]*?(?=[\p{L}\p{N}]|[(\[][^()\[\]]*[)\]][^\p{L}\p{N}]*[\p{L}\p{N}])"
    lead = F.when(F.col("w.many"), F.regexp_extract("w.value", own, 0)).otherwise(F.regexp_extract("w.value", r"^[^\p{L}\p{N}]*", 0))
    tail = F.regexp_extract("w.value", r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]+$", 0)
    core = F.substr("w.value", F.length(lead) + 1, F.length("w.value") - F.length(lead) - F.length(tail))
    rows = w.select(
        "doc", "h", (F.col("w.start") + F.length(lead)).alias("start"), (F.col("w.end") - F.length(tail)).alias("end"),
        F.trim(F.col("w.before")).alias("pattern"), core.alias("instance"), F.lit(False).alias("seed"),
    ).where(F.length("instance") >= min_length)
    return rows.union(seeds).where(F.col("pattern") != "")


def bootstrap(occ: DataFrame, rounds: int = 3, min_seeds: int = 3, min_score: float = 0.8) -> DataFrame:
    """Instances (instance) that confident patterns find and that are no seeds.

    Patterns and instances form a graph with one edge for each distinct pair. A
    seed scores 1. In each round a pattern scores the mean of its instances'
    scores, if ``min_seeds`` of them score at least ``min_score``, and an
    instance that is no seed scores one minus the product of what its patterns
    leave open, so it loses its score again with theirs. Both are sums by key with
    partial sums per task; no group meets in one task.
    """
    seed = F.max("seed").alias("seed")
    edges = occ.groupBy("pattern", "instance").agg(seed)
    seeds = occ.groupBy("instance").agg(seed).withColumn("score", F.col("seed").cast("double"))
    edges = written(edges.drop("seed").join(seeds, "instance").select("pattern", "instance", "seed", "score"), "pii-edges")
    for i in range(rounds):
        good = F.sum((F.col("score") >= min_score).cast("int"))
        patterns = (
            edges.groupBy("pattern")
            .agg(F.avg("score").alias("trust"), good.alias("good"))
            .where((F.col("good") >= min_seeds) & (F.col("trust") >= min_score))
            .select("pattern", "trust")
        )
        scored = edges.join(patterns, "pattern", "left")
        open_ = F.exp(F.sum(F.log(F.greatest(1 - F.coalesce("trust", F.lit(0.0)), F.lit(1e-12)))))
        new = scored.groupBy("instance").agg(F.when(F.max("seed"), 1.0).otherwise(F.round(1 - open_, 9)).alias("score"))
        edges = written(edges.drop("score").join(new, "instance").select("pattern", "instance", "seed", "score"), f"pii-edges-{i}")
    return edges.where(F.col("score") >= min_score).select("instance").distinct()


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3,
    min_seeds: int = 3, min_score: float = 0.8, min_length: int = 6,
) -> DataFrame:
    """Per row of ``docs``: doc_id, base and spans, arrays of (start, end, kind, value).

    ``base`` has the fixed forms email, ip, card and phone (kinds 0 to 3), the
    matches of each without overlap, failing ones left out. ``spans`` has them
    and the learned identifiers (kind 4): numbered words, runs of them and words
    with an @ that patterns (the word before) with many seeds find anywhere in the
    corpus. The value of a run has one space between its words.

    Null or empty text: no spans. Rows equal in id and text get equal spans. A
    null id is an ordinary one. No rows: none. Other columns play no part.
    """
    found = written(base_spans(docs, id_col, text_col), "pii-found")
    occ = written(occurrences(found, min_length), "pii-words")
    fresh_ids = bootstrap(occ, rounds, min_seeds, min_score)
    learned = (
        occ.where(~F.col("seed"))
        .join(fresh_ids, "instance")
        .groupBy("doc", "h")
        .agg(F.collect_set(F.struct("start", "end", F.lit(4).alias("kind"), F.col("instance").alias("value"))).alias("more"))
        .select(F.col("doc").alias("d2"), F.col("h").alias("h2"), "more")
    )
    out = found.join(learned, every([found["doc"].eqNullSafe(learned["d2"]), found["h"].eqNullSafe(learned["h2"])]), "left")
    # a word within a found run is told by the run; runs have a space inside and no overlap
    out = out.withColumn("more", F.coalesce(F.array_sort("more"), F.array().cast(SPAN)))
    out = out.withColumn("runs", F.filter("more", lambda x: F.instr(x["value"], " ") > 0))

    def within(x: Column) -> Column:
        y = F.get("runs", starting_before(F.col("runs"), x["start"] + 1) - 1)
        return F.coalesce((y["end"] >= x["end"]) & (y["end"] - y["start"] > x["end"] - x["start"]), F.lit(False))

    more = F.filter("more", lambda x: ~within(x))
    return out.select(F.col("doc").alias("doc_id"), "base", F.concat("base", more).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of all spans by start, then kind."""
    key = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(F.transform(spans, key)),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def digest(found: DataFrame) -> DataFrame:
    """The result columns of the query from those of ``find``."""
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(FORMS)],
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"),
    )
