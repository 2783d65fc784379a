"""Small tables with every hazard, and plain-Python counterparts of the operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "\n" + "x" * 50_000
# id, text, lang, source, n_chars and columns named like those that operators make on the way
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, h string, doc int, pos int, _t string"
HAZARDS = [
    (None, None, None, None, None),
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (3, " \n\t ", None, "a", 4),
    (4, LONG, "en", "b", len(LONG)),
    (5, "same line one\nsame line two\nsame line three\nown end", "en", "a", 50),
    (6, "same line one\nsame line two\nsame line three\nother end", "en", "b", 50),
    (6, "same line one\nsame line two\nsame line three\nother end", "en", "b", 50),
    (7, "a\nb", "en", "b", 3),
    (None, "a text without an id but with words in it, mail x.y@z.example.org", "en", "c", 60),
]


def hazards(spark):
    rows = [(*r, 1, "h", 2, 3, "t") for r in HAZARDS]
    return spark.createDataFrame(rows, SCHEMA)


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def without_later_runs(docs, cut, unit, length, words, glue):
    """docs (id, text) -> {id: (kept text, units, removed)} by the definition of the window operators."""
    first, later, units = {}, defaultdict(set), {}
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        units[d] = u = cut(t)
        for p in range(len(u) - length + 1):
            run = tuple(unit(x) for x in u[p : p + length])
            if words(run):
                if first.setdefault(run, (d, p)) != (d, p):
                    later[d] |= set(range(p, p + length))
    return {
        d: (glue.join(x for i, x in enumerate(u) if i not in later[d]), len(u), len(later[d])) for d, u in units.items()
    }


FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 12 <= len(d) <= 19 and sum(t - 9 * (t > 9) for t in twice) % 10 == 0
    return True


def base_spans(text):
    return sorted(
        (m.start(), i, m.end(), k)
        for i, (k, p) in enumerate(FORMS.items())
        for m in re.finditer(p, text or "")
        if _holds(k, m[0])
    )


def span_hash(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()


def bag(text, width=5):
    w = [x for x in re.split(r"[ \n\t\r]+", text or "") if x]
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else Counter()


def classes(ids, links):
    """{id: smallest id reached}."""
    low = {i: i for i in ids}

    def find(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_links(docs, similarity=0.8):
    bags = {d: bag(t) for d, t in docs}
    holders = defaultdict(list)
    for d, b in bags.items():
        for s in b:
            holders[s].append(d)
    pairs = {(a, b) for ds in holders.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        both = sum((bags[a] & bags[b]).values())
        if both >= similarity * (bags[a].total() + bags[b].total() - both):
            yield a, b
