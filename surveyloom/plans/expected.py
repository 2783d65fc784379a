"""SQL that states, for the test engine, what the named queries return.

Written from the operators' definitions, independently of their expressions.
"""

from __future__ import annotations

# Fixed values, stated here once more so that a wrong word of the operators shows.
ALIASES = {
    "blueberries": "blueberry",
    "noodles": "noodle",
    "violins": "violin",
    "slowly": "slow",
    "icecream": "ice",
}
STOP_WORDS = """
'd 'll 'm 're 's 've a about above across after afterwards again against all almost alone along
already also although always am among amongst amoungst amount an and another any anyhow anyone
anything anyway anywhere are around as at back be became because become becomes becoming been before
beforehand behind being below beside besides between beyond bill both bottom but by ca call can
cannot cant co con could couldnt cry de describe detail did do does doing done down due during each
eg eight either eleven else elsewhere empty enough etc even ever every everyone everything
everywhere except few fifteen fifty fill find fire first five for former formerly forty found four
from front full further get give go had has hasnt have he hence her here hereafter hereby herein
hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it
its itself just keep last latter latterly least less ltd made make many may me meanwhile might mill
mine more moreover most mostly move much must my myself n't name namely neither never nevertheless
next nine no nobody none noone nor not nothing now nowhere n‘t n’t of off often on once one only
onto or other others otherwise our ours ourselves out over own part per perhaps please put quite
rather re really regarding same say see seem seemed seeming seems serious several she should show
side since sincere six sixty so some somehow someone something sometime sometimes somewhere still
such system take ten than that the their them themselves then thence there thereafter thereby
therefore therein thereupon these they thick thin third this those though three through throughout
thru thus to together too top toward towards twelve twenty two un under unless until up upon us used
using various very via was we well were what whatever when whence whenever where whereafter whereas
whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will
with within without would yet you your yours yourself yourselves ‘d ‘ll ‘m ‘re ‘s ‘ve ’d ’ll ’m ’re
’s ’ve
""".split()

SPACES = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
# a word bound for an engine whose \b knows ASCII only
NOT_WORD = r"[^\pL\pM\pN_]"

NORMAL = (
    "trim(regexp_replace(replace(replace(lower(coalesce(text, '')), '–', '-'), '—', '-'), "
    f"'{SPACES}', ' ', 'g'))"
)


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words(*phrases: str) -> str:
    return f"'(^|{NOT_WORD})(" + "|".join(p.replace("'", "''") for p in phrases) + f")({NOT_WORD}|$)'"


def tokens(text: str) -> str:
    """Token list of a text expression."""
    swapped = (
        f"replace(replace(replace(lower(coalesce({text}, 'missing')), '’', ''''), '‘', ''''), '-', ' ')"
    )
    words = (
        f"list_filter(list_transform(string_split_regex({swapped}, '[^a-z'']+'), lambda w: trim(w, '''')), "
        "lambda w: w <> '')"
    )
    aliases = " ".join(f"WHEN t = {_quote(a)} THEN {_quote(b)}" for a, b in ALIASES.items())
    single = (
        f"CASE {aliases} WHEN length(t) <= 3 THEN t "
        "WHEN suffix(t, 'ies') AND length(t) > 4 THEN t[:-4] || 'y' "
        "WHEN suffix(t, 'es') AND length(t) > 4 AND NOT suffix(t, 'ses') THEN t[:-3] "
        "WHEN suffix(t, 's') AND NOT suffix(t, 'ss') THEN t[:-2] ELSE t END"
    )
    stops = "[" + ", ".join(_quote(w) for w in STOP_WORDS) + "]"
    return (
        f"list_filter(list_transform({words}, lambda t: {single}), "
        f"lambda t: length(t) >= 2 AND NOT list_contains({stops}, t))"
    )


def naive_bayes(
    source: str, keys: list[str], text: str, label: str, k: int, alpha: float = 0.5
) -> str:
    """CTEs: par (class, ci, token, p), cls (class, ci, n), sc (keys, class, ci, score, hits)."""
    key = ", ".join(keys)
    on = " AND ".join(f"s.{c} = h.{c}" for c in keys)
    return f"""
    src AS ({source}),
    tok AS (SELECT {key}, {label} AS y, list_distinct({tokens(text)}) AS toks FROM src),
    ex AS (SELECT {key}, y, t FROM (SELECT {key}, y, unnest(toks) AS t FROM tok) WHERE t <> 'missing'),
    vocab AS (SELECT t, count(*) AS df FROM ex GROUP BY t ORDER BY df DESC, t LIMIT {k}),
    cls AS (SELECT y, n, row_number() OVER (ORDER BY y) - 1 AS ci, sum(n) OVER () AS total
            FROM (SELECT y, count(*) AS n FROM tok GROUP BY y)),
    seen AS (SELECT y, t, count(*) AS c FROM ex WHERE t IN (SELECT t FROM vocab) GROUP BY y, t),
    par AS (SELECT cls.y, cls.ci, v.t,
                   (coalesce(s.c, 0) + {alpha}::DOUBLE) / (cls.n + 2 * {alpha}::DOUBLE) AS p
            FROM cls CROSS JOIN vocab v LEFT JOIN seen s ON s.y = cls.y AND s.t = v.t),
    base AS (SELECT cls.y, cls.ci, ln(any_value(cls.n)::DOUBLE / any_value(cls.total)) AS prior, sum(ln(1 - p)) AS miss
             FROM cls JOIN par ON par.y = cls.y GROUP BY cls.y, cls.ci),
    hit AS (SELECT {key}, t FROM ex WHERE t IN (SELECT t FROM vocab)),
    nh AS (SELECT {key}, count(*) AS hits FROM hit GROUP BY {key}),
    add AS (SELECT {', '.join('h.' + c for c in keys)}, par.ci, sum(ln(par.p) - ln(1 - par.p)) AS d
            FROM hit h JOIN par ON par.t = h.t GROUP BY {', '.join('h.' + c for c in keys)}, par.ci),
    sc AS (SELECT {', '.join('s.' + c for c in keys)}, b.y, b.ci, coalesce(n.hits, 0) AS hits,
                  CASE WHEN coalesce(n.hits, 0) = 0 THEN b.prior ELSE b.prior + b.miss + h.d END AS score
           FROM tok s CROSS JOIN base b
           LEFT JOIN nh n ON {' AND '.join(f's.{c} = n.{c}' for c in keys)}
           LEFT JOIN add h ON {on} AND h.ci = b.ci),
    top AS (SELECT {key}, max(score) AS best FROM sc GROUP BY {key}),
    pr AS (SELECT {', '.join('sc.' + c for c in keys)}, sc.y, sc.ci, sc.hits, exp(sc.score - top.best) AS e,
                  row_number() OVER (PARTITION BY {', '.join('sc.' + c for c in keys)} ORDER BY sc.score DESC, sc.ci) AS place
           FROM sc JOIN top ON {' AND '.join(f'sc.{c} = top.{c}' for c in keys)})
    """


def nb_scores(source: str, keys: list[str], text: str, label: str, k: int, classes: int, prefix: str = "") -> str:
    """One row per key: probabilities, prediction, hit count, zero-hit flag."""
    probs = ", ".join(
        f"round(max(CASE WHEN ci = {i} THEN e END) / sum(e), 6) AS {prefix}p{i}" for i in range(classes)
    )
    key = ", ".join(keys)
    return (
        f"WITH {naive_bayes(source, keys, text, label, k)} SELECT {key}, {probs}, "
        f"max(CASE WHEN place = 1 THEN y END) AS {prefix}pred, any_value(hits)::INTEGER AS {prefix}hit_count, "
        f"(any_value(hits) = 0)::INTEGER AS {prefix}zero_hit FROM pr GROUP BY {key}"
    )


def nb_parameters(source: str, keys: list[str], text: str, label: str, k: int) -> str:
    return (
        f"WITH {naive_bayes(source, keys, text, label, k)} SELECT y AS class, t AS token, round(p, 6) AS p, "
        "round(ln(p), 6) AS log_p, round(ln(1 - p), 6) AS log_not_p FROM par"
    )


PRIORITY = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 "
    "WHEN '4-NOT SPECIFIED' THEN 4 END"
)
# the amount each phrase names, up to the cap
OFFER = """CASE o_orderkey % 8
    WHEN 0 THEN v WHEN 1 THEN v * 1000 WHEN 2 THEN NULL WHEN 3 THEN 0 WHEN 4 THEN v + 700
    WHEN 5 THEN v WHEN 6 THEN least(v * 1000000, 324000000) ELSE v * 1000 + 512 END::DOUBLE"""
ORDERS = "(SELECT *, o_orderkey % 900 + 11 AS v FROM orders)"

PARTS = """(SELECT p_partkey,
        CASE WHEN p_size BETWEEN 5 AND 40 THEN p_size::DOUBLE END AS size,
        CASE WHEN p_retailprice BETWEEN 910 AND 1500 THEN p_retailprice END AS price,
        CASE WHEN p_brand <> 'Brand#7' THEN p_brand END AS brand,
        CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3
            WHEN 'SMALL' THEN 4 END::INTEGER AS label
    FROM part)"""

# the order survey with its typed answers, before and after the bounds
SURVEY = f"""
    typed AS (SELECT o_orderkey, o_orderstatus AS status,
            CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END::INTEGER AS label,
            ({PRIORITY})::DOUBLE AS priority,
            CASE o_orderkey % 8 WHEN 6 THEN v * 1000000::DOUBLE ELSE {OFFER} END AS raw_offer,
            {OFFER} AS offer,
            CASE WHEN o_orderkey % 11 <> 0 THEN (o_custkey % 97 - 3)::DOUBLE END AS raw_units,
            (o_orderkey % 13)::DOUBLE AS raw_rate,
            CASE WHEN o_orderkey % 7 <> 0 THEN 'noted' END AS note
        FROM {ORDERS}),
    cap AS (SELECT ceil(quantile_cont(greatest(raw_units, 0), 0.99)) AS u FROM typed WHERE raw_units IS NOT NULL),
    bound AS (SELECT typed.*, u,
            CASE WHEN raw_units IS NOT NULL THEN least(greatest(raw_units, 0), u) END AS units,
            CASE WHEN raw_rate BETWEEN 1 AND 10 THEN raw_rate END AS rate
        FROM typed CROSS JOIN cap),
    kept AS (SELECT * FROM bound WHERE (label IS NULL)::INT + (priority IS NULL)::INT + (offer IS NULL)::INT
            + (units IS NULL)::INT + (rate IS NULL)::INT + (note IS NULL)::INT < 3),
    med AS (SELECT median(priority) AS priority, median(offer) AS offer, median(units) AS units,
            median(rate) AS rate FROM kept)
"""

CLEANED = f"""WITH {SURVEY} SELECT o_orderkey::VARCHAR AS order_id, status,
            round_even(coalesce(k.priority, m.priority), 0)::BIGINT AS priority,
            coalesce(k.offer, m.offer) AS offer,
            round_even(coalesce(k.units, m.units), 0)::BIGINT AS units,
            round_even(coalesce(k.rate, m.rate), 0)::BIGINT AS rate,
            coalesce(note, 'Missing') AS note, label FROM kept k CROSS JOIN med m"""

CATEGORIES = [
    "anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large",
    "new", "old", "plate", "red", "ring", "rod", "small", "widget",
]


def _metric(step: str, column: str, metric: str, cond: str, source: str) -> str:
    return (
        f"SELECT '{step}' AS step, '{column}' AS \"column\", '{metric}' AS metric, "
        f"count(*) FILTER (WHERE {cond}) AS value FROM {source}"
    )


def _audit() -> str:
    parts = [
        _metric("rows", "*", "raw", "true", "typed"),
        _metric("payment", "offer", "negative_to_zero", "raw_offer < 0", "typed"),
        _metric("payment", "offer", "capped", "raw_offer > 324000000", "typed"),
        _metric("count", "units", "negative_to_zero", "raw_units < 0", "typed"),
        _metric("count", "units", "capped", "raw_units > u", "bound"),
        _metric("scale", "rate", "out_of_range", "raw_rate < 1 OR raw_rate > 10", "typed"),
        _metric("scale", "priority", "out_of_range", "priority < 1 OR priority > 5", "typed"),
        _metric("rows", "*", "kept", "true", "kept"),
    ]
    for c in ("offer", "rate", "units", "priority"):
        parts.append(_metric("missing", c, "before_fill", f"{c} IS NULL", "kept"))
    for c in ("status", "note"):
        parts.append(_metric("missing", c, "before_fill", f"{c} IS NULL", "kept"))
    for c in ("offer", "rate", "units", "priority", "status", "note"):
        parts.append(_metric("missing", c, "after_fill", "false", "kept"))
    return f"WITH {SURVEY} " + " UNION ALL ".join(parts)


def nb_fold_scores(k: int) -> str:
    """Accuracy of each of three folds, fitted on the other two."""
    return f"""
    src AS (SELECT conv_id * 1000 + turn AS row_id, role AS y, text FROM conversations),
    rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || row_id), row_id) AS rn FROM src),
    bf AS (SELECT y, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM (SELECT y, count(*) AS n, min(row_id) AS f FROM src GROUP BY y)),
    tok AS (SELECT row_id, rk.y, ((before + rn - 1) % 3)::INTEGER AS fold, list_distinct({tokens('text')}) AS toks
            FROM rk JOIN bf ON rk.y = bf.y),
    ex AS (SELECT row_id, fold, y, t FROM (SELECT row_id, fold, y, unnest(toks) AS t FROM tok) WHERE t <> 'missing'),
    fs AS (SELECT unnest([0, 1, 2]) AS f),
    df AS (SELECT f, t, count(*) AS df FROM ex JOIN fs ON fold <> f GROUP BY f, t),
    vocab AS (SELECT f, t FROM df QUALIFY row_number() OVER (PARTITION BY f ORDER BY df DESC, t) <= {k}),
    cls AS (SELECT f, y, count(*) AS n FROM tok JOIN fs ON fold <> f GROUP BY f, y),
    seen AS (SELECT f, y, t, count(*) AS c FROM ex JOIN fs ON fold <> f GROUP BY f, y, t),
    par AS (SELECT c.f, c.y, v.t, (coalesce(s.c, 0) + 0.5::DOUBLE) / (c.n + 1.0::DOUBLE) AS p
            FROM cls c JOIN vocab v ON v.f = c.f LEFT JOIN seen s ON s.f = c.f AND s.y = c.y AND s.t = v.t),
    base AS (SELECT p.f, p.y, any_value(ln(c.n::DOUBLE / total)) AS prior, sum(ln(1 - p)) AS miss
             FROM par p JOIN (SELECT *, sum(n) OVER (PARTITION BY f) AS total FROM cls) c ON c.f = p.f AND c.y = p.y
             GROUP BY p.f, p.y),
    add AS (SELECT e.row_id, p.y, sum(ln(p) - ln(1 - p)) AS d FROM ex e JOIN par p ON p.f = e.fold AND p.t = e.t GROUP BY e.row_id, p.y),
    sc AS (SELECT tok.row_id, tok.fold, tok.y AS truth, b.y, CASE WHEN d IS NULL THEN prior ELSE prior + miss + d END AS score
           FROM tok JOIN base b ON b.f = tok.fold LEFT JOIN add ON add.row_id = tok.row_id AND add.y = b.y),
    acc AS (SELECT fold, avg((y = truth)::INTEGER::DOUBLE) AS acc
            FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, y) = 1) GROUP BY fold)
    SELECT 'k={k}' AS params, round(max(acc) FILTER (WHERE fold = 0), 6) AS fold0, round(max(acc) FILTER (WHERE fold = 1), 6) AS fold1,
           round(max(acc) FILTER (WHERE fold = 2), 6) AS fold2, avg(acc) AS mean_acc, stddev_pop(acc) AS std_acc FROM acc"""


def order_model(steps: int = 15) -> str:
    """CTEs: train (cleaned orders of odd keys), mom (m, s), fit (b, d): log-odds b + d * scaled rate, by Newton steps."""
    cleaned = CLEANED.replace("FROM orders)", "FROM orders WHERE o_orderkey % 2 = 1)")
    ctes = [
        f"train AS (SELECT * FROM ({cleaned}) WHERE label IS NOT NULL)",
        "mom AS (SELECT avg(rate) AS m, stddev_pop(rate) AS s FROM train)",
        # the penalty 1 / (C * rows) lies on both classes' weights, d / 2 and -d / 2
        "grp AS (SELECT (rate - m) / s AS x, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS ones FROM train CROSS JOIN mom GROUP BY 1)",
        "tot AS (SELECT sum(n) AS n, 1 / (0.5 * sum(n)) / 2 AS half FROM grp)",
        "w0 AS (SELECT 0::DOUBLE AS b, 0::DOUBLE AS d)",
    ]
    for i in range(steps):
        ctes.append(f"""w{i + 1} AS (SELECT b - (hdd * gb - hbd * gd) / (hbb * hdd - hbd * hbd) AS b,
                d - (hbb * gd - hbd * gb) / (hbb * hdd - hbd * hbd) AS d FROM
            (SELECT b, d, sum(n * p - ones) / t AS gb, sum((n * p - ones) * x) / t + half * d AS gd, sum(n * p * (1 - p)) / t AS hbb,
                    sum(n * p * (1 - p) * x) / t AS hbd, sum(n * p * (1 - p) * x * x) / t + half AS hdd FROM
                (SELECT grp.*, b, d, tot.n AS t, half, 1 / (1 + exp(-(b + d * x))) AS p FROM grp CROSS JOIN w{i} CROSS JOIN tot)
             GROUP BY b, d, t, half))""")
    return ", ".join(ctes) + f", fit AS (SELECT * FROM w{steps})"


ORDER_REPORT = """
    part AS (SELECT o_orderkey, o_orderkey % 101 = 0 AS torn, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END::INTEGER AS label,
            CASE WHEN o_orderkey % 13 BETWEEN 1 AND 10 THEN (o_orderkey % 13)::DOUBLE END AS rate FROM orders WHERE o_orderkey % 2 = 0),
    mid AS (SELECT median(rate) AS r FROM part WHERE NOT torn),
    odds AS (SELECT part.*, 1 / (1 + exp(-(b + d * (round_even(coalesce(rate, r), 0) - m) / s))) AS p
            FROM part CROSS JOIN mid CROSS JOIN mom CROSS JOIN fit),
    report AS (SELECT o_orderkey::VARCHAR AS order_id,
            CASE WHEN torn THEN 'damaged' WHEN label IS NULL THEN 'unknown' ELSE 'scored' END AS state,
            CASE WHEN NOT torn THEN label END AS label, CASE WHEN NOT torn THEN CASE label WHEN 0 THEN 'F' WHEN 1 THEN 'O' END END AS true_name,
            CASE WHEN NOT torn THEN (p > 0.5)::INTEGER END AS pred, CASE WHEN NOT torn THEN CASE WHEN p > 0.5 THEN 'O' ELSE 'F' END END AS pred_name,
            CASE WHEN NOT torn THEN round(p, 4) END AS p1 FROM odds)
"""


def sql() -> dict[str, str]:
    docs, conv = "SELECT * FROM documents", "SELECT * FROM conversations"
    keyed = "md5('42:' || {0})"
    parts_nb = nb_scores("SELECT * FROM part", ["p_partkey"], "p_name", "p_type", 10, 6, "p_name_nb_")
    flags = ", ".join(
        f"list_contains(string_split(p_name, ' '), '{c}')::INTEGER AS p_name__{c}" for c in CATEGORIES
    )
    roles = ", ".join(
        f"max((role = '{r}')::INTEGER) AS roles__{r}" for r in ("assistant", "system", "user")
    )
    z = ", ".join(
        f"round(({c} - m_{c}) / s_{c}, 6) AS {c}"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
    zs = ", ".join(
        f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
    held = "round_even(n * {0}::DOUBLE, 0)"
    knn = f"""WITH split AS (SELECT vec_id, label, embedding, rn <= (CASE WHEN n >= 2
                THEN greatest(1, least(n - 1, {held.format('0.8')})) ELSE {held.format('0.8')} END) AS is_train FROM
                (SELECT *, count(*) OVER (PARTITION BY label) AS n,
                    row_number() OVER (PARTITION BY label ORDER BY {keyed.format('vec_id')}, vec_id) AS rn FROM embeddings)),
            dist AS (SELECT q.vec_id, t.vec_id AS tid, t.label, list_sum(list_transform(list_zip(q.embedding, t.embedding),
                lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) AS d FROM split q JOIN split t ON NOT q.is_train AND t.is_train),
            near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, tid) AS r FROM dist) WHERE r <= 27),
            votes AS (SELECT vec_id, label, count(*) FILTER (WHERE d = 0) AS z, sum(CASE WHEN d > 0 THEN 1 / d ELSE 0 END) AS w
                FROM near GROUP BY 1, 2),
            best AS (SELECT vec_id, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id
                ORDER BY z DESC, CASE WHEN z = 0 THEN w ELSE 0 END DESC, label) AS r FROM votes) WHERE r = 1)
            SELECT vec_id, pred, round(min(d), 6) AS nearest, round(max(d), 6) AS farthest
            FROM near JOIN best USING (vec_id) GROUP BY vec_id, pred"""
    return {
        "schema_complete": "SELECT *, CAST(NULL AS VARCHAR) AS c_phone, CAST(NULL AS VARCHAR) AS c_comment FROM customer",
        "normalize_text": f"SELECT doc_id, {NORMAL} AS text FROM documents",
        "collapse_thousands": "SELECT o_orderkey, 'cad ' || (o_orderkey * 7919 + 1000003) || ' for order ' || o_orderkey AS text FROM orders",
        "text_flags": f"""SELECT doc_id,
            regexp_matches(t, {_words('not sure', 'unsure', 'idk', "i don't know", 'cannot decide', "can't decide", 'no idea')}) AS uncertain,
            regexp_matches(t, {_words('0+', 'zero', 'nothing', 'no money', 'free')}) AS zero,
            regexp_matches(t, {_words('the', 'la')}) AS article
            FROM (SELECT doc_id, {NORMAL} AS t FROM documents)""",
        "text_patterns": f"""SELECT doc_id, regexp_matches(t, {_words('t?he')}) AS optional,
            regexp_matches(t, {_words('las', 'les', 'd[ae]s')}) AS either
            FROM (SELECT doc_id, {NORMAL} AS t FROM documents)""",
        "parse_money_kinds": f"""SELECT o_orderkey, CASE o_orderkey % 16
            WHEN 0 THEN v * 1e9 WHEN 1 THEN v WHEN 2 THEN v * 1e9 WHEN 3 THEN v * 1e6 WHEN 4 THEN v * 1e3 + 500
            WHEN 5 THEN v * 1e3 WHEN 6 THEN v WHEN 7 THEN v + 700 WHEN 8 THEN v WHEN 9 THEN v WHEN 10 THEN v * 1e3
            WHEN 11 THEN v WHEN 12 THEN NULL WHEN 13 THEN v + 700 WHEN 14 THEN v + 700 ELSE v END::DOUBLE AS amount FROM {ORDERS}""",
        "parse_money": f"SELECT o_orderkey, {OFFER} AS amount FROM {ORDERS}",
        "ordinal_map": f"SELECT o_orderkey, ({PRIORITY})::INTEGER AS level, CASE WHEN ({PRIORITY}) IS NOT NULL THEN o_orderpriority END AS title FROM orders",
        "numeric_coerce": """SELECT p_partkey, x AS number,
            CASE WHEN x IS NOT NULL THEN round_even(least(greatest(x, -20), 1000), 0)::BIGINT END AS whole
            FROM (SELECT p_partkey, TRY_CAST(CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_name
                WHEN 2 THEN p_retailprice::VARCHAR WHEN 3 THEN '-' || p_size || '.5' ELSE p_size || 'e2' END AS DOUBLE) AS x
            FROM part)""",
        "bounded_scale": "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN p_size::DOUBLE END AS size FROM part",
        "count_cap": """SELECT c_custkey, round_even(least(greatest(c_acctbal, 0), u), 0)::DOUBLE AS acctbal FROM customer
            CROSS JOIN (SELECT ceil(quantile_cont(greatest(c_acctbal, 0), 0.99)) AS u FROM customer)""",
        "count_cap_events": """SELECT event_id, round_even(least(greatest(value, 0), u), 0)::DOUBLE AS value FROM events
            CROSS JOIN (SELECT ceil(quantile_cont(greatest(value, 0), 0.99)) AS u FROM events)""",
        "missing_filter": f"""SELECT * FROM (SELECT *,
            (size IS NULL)::INT + (price IS NULL)::INT + (brand IS NULL)::INT + (label IS NULL)::INT AS missing FROM {PARTS})
            WHERE missing < 2 AND label IS NOT NULL""",
        "median_impute": f"""SELECT p_partkey, coalesce(size, ms) AS size, coalesce(price, mp) AS price,
            coalesce(brand, 'Missing') AS brand FROM {PARTS}
            CROSS JOIN (SELECT median(size) AS ms, median(price) AS mp FROM {PARTS})""",
        "median_spiky": """SELECT quantile_cont(v, 0.1) AS low, median(v) AS middle, quantile_cont(v, 0.99) AS high FROM
            (SELECT CASE WHEN l_orderkey % 8 < 3 THEN 1.0 WHEN l_orderkey % 8 < 6 THEN 2.0 WHEN l_orderkey % 8 = 6
                THEN -l_extendedprice ELSE l_extendedprice + 2 END::DOUBLE AS v FROM lineitem)""",
        "median_merged": """SELECT c AS "column", q::DOUBLE AS q, n, true AS holds FROM
            (SELECT 'l_extendedprice' AS c, count(l_extendedprice) AS n FROM lineitem UNION ALL SELECT 'l_quantity', count(l_quantity) FROM lineitem)
            CROSS JOIN (SELECT unnest([0.25, 0.5, 0.99]) AS q)""",
        "logistic_one": f"""WITH {order_model()} SELECT order_id, label, round(p, 4) AS p1, CASE WHEN p > 0.5 THEN 'O' ELSE 'F' END AS pred_name
            FROM (SELECT order_id, label, 1 / (1 + exp(-(b + d * (rate - m) / s))) AS p FROM train CROSS JOIN mom CROSS JOIN fit)""",
        "score_file": f"WITH {order_model()}, {ORDER_REPORT} SELECT * FROM report",
        "evaluate_file": f"""WITH {order_model()}, {ORDER_REPORT} SELECT count(*) AS lines, count(*) FILTER (WHERE state = 'damaged') AS damaged,
            count(*) FILTER (WHERE state = 'unknown') AS unknown, count(*) FILTER (WHERE state = 'scored') AS scored,
            round(avg((pred = label)::INTEGER::DOUBLE) FILTER (WHERE state = 'scored'), 6) AS accuracy FROM report""",
        "audit_counts": " UNION ALL ".join(
            [
                _metric("rows", "*", "raw", "true", "events"),
                _metric("count", "value", "negative_to_zero", "value < 0", "events"),
                _metric("count", "value", "capped", "value > 100", "events"),
                _metric("scale", "value", "out_of_range", "value < 1 OR value > 10", "events"),
                _metric("missing", "event_type", "null", "event_type IS NULL", "events"),
            ]
        ),
        "value_counts": "SELECT nullif(o_orderstatus, 'P') AS value, count(*) AS n FROM orders GROUP BY 1",
        "clean_table": CLEANED,
        "clean_audit": _audit(),
        "csv_round_trip": CLEANED,
        "resolve_mixed": CLEANED.replace("FROM orders)", "FROM orders WHERE o_orderkey % 2 = 0)")
        + f" UNION ALL SELECT * FROM ({CLEANED}) WHERE order_id::BIGINT % 2 = 1",
        "fill_fallback": """WITH p AS (SELECT p_partkey,
                CASE WHEN p_size BETWEEN 5 AND 40 AND p_partkey % 2 = 0 THEN p_size::DOUBLE END AS size,
                CASE WHEN p_retailprice BETWEEN 910 AND 1500 THEN p_retailprice END AS price FROM part)
            SELECT p_partkey, coalesce(size, (SELECT median(size) FROM p WHERE p_partkey % 2 = 0)) AS size,
                coalesce(price, (SELECT median(price) FROM p WHERE p_partkey % 2 = 1)) AS price, 0.0::DOUBLE AS none
            FROM p WHERE p_partkey % 2 = 1""",
        "tokenize": f"""SELECT doc_id, len(t)::INTEGER AS n, coalesce(array_to_string(t, ' '), '') AS tokens
            FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)""",
        "vocab_topk": f"""SELECT t AS token, count(*) AS df FROM (SELECT unnest(list_distinct({tokens('text')})) AS t FROM documents)
            WHERE t <> 'missing' GROUP BY t ORDER BY df DESC, t LIMIT 20""",
        "multi_hot": f"SELECT p_partkey, p_name, {flags} FROM part",
        "multi_hot_slugs": """SELECT doc_id, (k < 3)::INTEGER AS tags__src_1, (k = 2)::INTEGER AS tags__src_1_2,
            (k > 3)::INTEGER AS tags__src_1_3, (k % 2 = 0)::INTEGER AS tags__, (k = 5)::INTEGER AS tags___2
            FROM (SELECT doc_id, doc_id % 7 AS k FROM documents)""",
        "multi_hot_roles": f"SELECT conv_id, {roles} FROM conversations GROUP BY conv_id",
        "hit_count": f"""WITH tok AS (SELECT doc_id, list_distinct({tokens('text')}) AS ts FROM documents),
            vocab AS (SELECT t, count(*) AS df FROM (SELECT unnest(ts) AS t FROM tok) WHERE t <> 'missing'
                GROUP BY t ORDER BY df DESC, t LIMIT 20)
            SELECT doc_id, len(list_intersect(ts, v))::INTEGER AS hits, (len(list_intersect(ts, v)) = 0)::INTEGER AS zero_hit
            FROM tok CROSS JOIN (SELECT list(t) AS v FROM vocab)""",
        "token_presence": f"""WITH tok AS (SELECT doc_id, list_distinct({tokens('text')}) AS ts FROM documents),
            vocab AS (SELECT t, count(*) AS df FROM (SELECT unnest(ts) AS t FROM tok) WHERE t <> 'missing'
                GROUP BY t ORDER BY df DESC, t LIMIT 20)
            SELECT doc_id, array_to_string(list_transform(v, lambda t: list_contains(ts, t)::INTEGER::VARCHAR), '') AS presence
            FROM tok CROSS JOIN (SELECT list(t ORDER BY df DESC, t) AS v FROM vocab)""",
        "nb_fit": nb_parameters(conv, ["conv_id", "turn"], "text", "role", 40),
        "nb_fit_documents": nb_parameters(docs, ["doc_id"], "text", "lang", 40),
        "nb_predict": nb_scores(conv, ["conv_id", "turn"], "text", "role", 40, 3),
        "nb_predict_documents": nb_scores(docs, ["doc_id"], "text", "lang", 40, 4),
        "nb_predict_wide": nb_scores(docs, ["doc_id"], "text", "lang", 5000, 4),
        "nb_folds": f"""SELECT params, fold0, fold1, fold2, round(mean_acc, 6) AS mean_acc, round(std_acc, 6) AS std_acc,
            row_number() OVER (ORDER BY mean_acc DESC, std_acc, params)::INTEGER AS place
            FROM ((WITH {nb_fold_scores(20)}) UNION ALL (WITH {nb_fold_scores(40)}))""",
        "text_accuracy": f"""WITH {naive_bayes(conv, ['conv_id', 'turn'], 'text', 'role', 40)}
            SELECT 'text' AS "column", round(avg((pr.y = tok.y)::INTEGER::DOUBLE), 6) AS accuracy
            FROM pr JOIN tok USING (conv_id, turn) WHERE place = 1""",
        "standardize": f"SELECT l_orderkey, l_linenumber, l_partkey, {z} FROM lineitem CROSS JOIN (SELECT {zs} FROM lineitem)",
        "feature_table": f"""SELECT part.p_partkey, p_size, p_retailprice, {flags}, s.* EXCLUDE (p_partkey, p_name_nb_pred),
            c.ci::INTEGER AS p_name_nb_pred, y.ci::INTEGER AS y
            FROM part JOIN ({parts_nb}) s ON s.p_partkey = part.p_partkey
            JOIN (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS ci FROM (SELECT DISTINCT p_type FROM part)) c
                ON c.p_type = s.p_name_nb_pred
            JOIN (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS ci FROM (SELECT DISTINCT p_type FROM part)) y
                ON y.p_type = part.p_type""",
        "kfold": f"""SELECT event_id, event_type, ((before + rn - 1) % 5)::INTEGER AS fold FROM
            (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {keyed.format('event_id')}, event_id) AS rn FROM events)
            JOIN (SELECT event_type, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                FROM (SELECT event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY event_type)) USING (event_type)""",
        "group_kfold": f"""WITH sizes AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
            major AS (SELECT user_id, event_type AS m FROM (SELECT *, row_number() OVER
                (PARTITION BY user_id ORDER BY n DESC, event_type DESC) AS r FROM sizes) WHERE r = 1),
            placed AS (SELECT user_id, row_number() OVER (ORDER BY m, {keyed.format('user_id')}, user_id) - 1 AS place FROM major)
            SELECT event_id, events.user_id, event_type, (place % 5)::INTEGER AS fold FROM events JOIN placed USING (user_id)""",
        "group_kfold_balanced": """WITH RECURSIVE g AS (SELECT user_id, count(*) AS n,
                ('0x' || left(md5('42:' || user_id), 8))::BIGINT % 320 AS bundle FROM events GROUP BY user_id),
            u AS (SELECT user_id, CASE WHEN n * 320 > (SELECT count(*) FROM events) THEN '=' || user_id ELSE bundle::VARCHAR END AS unit FROM g),
            c AS (SELECT event_type AS c, row_number() OVER (ORDER BY event_type) AS i,
                (1000000::HUGEINT * (SELECT count(*) FROM events) * (SELECT count(*) FROM events)) // (count(*) * count(*)) AS w
                FROM events GROUP BY event_type),
            z AS (SELECT count(*) AS m, list(w::HUGEINT ORDER BY i) AS ws FROM c),
            k AS (SELECT x.unit, c.i, coalesce(y.n, 0) AS n FROM (SELECT DISTINCT unit FROM u) x CROSS JOIN c
                LEFT JOIN (SELECT unit, event_type, count(*) AS n FROM events JOIN u USING (user_id) GROUP BY 1, 2) y
                ON y.unit = x.unit AND y.event_type = c.c),
            o AS (SELECT unit, row_number() OVER (ORDER BY sum(n) DESC, unit) AS step, sum(n)::HUGEINT AS size,
                list(n::HUGEINT ORDER BY i) AS ns FROM k GROUP BY unit),
            r(step, unit, fold, full_, rows_) AS (
                SELECT 0::BIGINT, ''::VARCHAR, -1::BIGINT, list_transform(range(5 * m), lambda x: 0::HUGEINT),
                    list_transform(range(5), lambda x: 0::HUGEINT) FROM z
                UNION ALL
                SELECT step, unit, best,
                    list_transform(range(1, 5 * m + 1), lambda x: full_[x] + CASE WHEN (x - 1) // m = best THEN ns[(x - 1) % m + 1] ELSE 0 END),
                    list_transform(range(5), lambda f: rows_[f + 1] + CASE WHEN f = best THEN size ELSE 0 END)
                FROM (SELECT *, list_position(costs, list_min(costs)) - 1 AS best FROM (
                    SELECT o.*, full_, rows_, m, list_transform(range(5), lambda f: list_reduce(list_transform(range(1, m + 1),
                        lambda j: ws[j] * ns[j] * full_[f * m + j]), lambda a, b: a + b) + 1000000 * m * size * rows_[f + 1]) AS costs
                    FROM r JOIN o ON o.step = r.step + 1, z)))
            SELECT event_id, events.user_id, event_type, fold::INTEGER AS fold FROM events JOIN u USING (user_id) JOIN r USING (unit)""",
        "holdout": f"""SELECT event_id, event_type, rn <= (CASE WHEN n >= 2 THEN greatest(1, least(n - 1, {held.format('0.8')}))
            ELSE {held.format('0.8')} END) AS is_train FROM
            (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type) AS n,
                row_number() OVER (PARTITION BY event_type ORDER BY {keyed.format('event_id')}, event_id) AS rn FROM events)""",
        "holdout_random": f"""SELECT event_id, event_type, rn <= {held.format('0.85')} AS is_train FROM
            (SELECT event_id, event_type, count(*) OVER () AS n,
                row_number() OVER (ORDER BY {keyed.format('event_id')}, event_id) AS rn FROM events)""",
        "knn": knn,
        "knn_cells": knn,
        "grid_search_knn": f"""WITH placed AS (SELECT *, row_number() OVER (ORDER BY first_, label, {keyed.format('vec_id')}, vec_id) - 1 AS place
                FROM (SELECT *, min(vec_id) OVER (PARTITION BY label) AS first_ FROM embeddings WHERE label IS NOT NULL)),
            f AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x, place % 3 AS fold FROM placed),
            d AS (SELECT q.vec_id, q.label AS truth, q.fold, t.vec_id AS tid, t.label, list_transform(list_zip(q.x, t.x), lambda e: abs(e[1] - e[2])) AS e
                FROM f q JOIN f t ON q.fold <> t.fold),
            s AS (SELECT * EXCLUDE e, 1 AS p, list_sum(e) AS d FROM d
                UNION ALL SELECT * EXCLUDE e, 2, sqrt(list_sum(list_transform(e, lambda v: v * v))) FROM d),
            n AS (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, tid) AS r FROM s QUALIFY r <= 13),
            v AS (SELECT vec_id, truth, fold, p, k, label, count(*)::DOUBLE AS votes, count(*) FILTER (d = 0) AS zero,
                sum(CASE WHEN d > 0 THEN 1 / d ELSE 0 END) AS near
                FROM n, (SELECT unnest([5, 7, 9, 11, 13]) AS k) WHERE r <= k GROUP BY ALL),
            w AS (SELECT *, 'uniform' AS weights, votes AS a, 0 AS b FROM v
                UNION ALL SELECT *, 'distance', zero, CASE WHEN zero = 0 THEN near ELSE 0 END FROM v),
            h AS (SELECT *, row_number() OVER (PARTITION BY vec_id, p, k, weights ORDER BY a DESC, b DESC, label) AS first_ FROM w QUALIFY first_ = 1),
            a AS (SELECT k, weights, p, fold, avg((label = truth)::INT) AS acc FROM h GROUP BY ALL),
            m AS (SELECT k, weights, p, avg(acc) AS mean_val_acc, stddev_pop(acc) AS std_val_acc FROM a GROUP BY ALL)
            SELECT row_number() OVER (ORDER BY round(mean_val_acc, 9) DESC, round(std_val_acc, 9), k, weights, p)::INTEGER AS place, k, weights, p,
                round(mean_val_acc, 6) AS mean_val_acc, round(std_val_acc, 6) AS std_val_acc FROM m""",
        "repeated_nb": f"""WITH r AS (SELECT conv_id * 1000 + turn AS id, role AS y, list_distinct({tokens('text')}) AS toks FROM conversations),
            m AS (SELECT id, y, s AS seed, ('0x' || substr(sha256((s // 32) || ':' || id), (2 * (s % 32) + 1)::INT, 2))::INT < 205 AS inside
                FROM r, range(50) x(s)),
            ex AS (SELECT id, y, t FROM (SELECT id, y, unnest(toks) AS t FROM r) WHERE t <> 'missing'),
            cls AS (SELECT seed, y, count(*) AS n, row_number() OVER (PARTITION BY seed ORDER BY y) AS ci, sum(count(*)) OVER (PARTITION BY seed) AS total
                FROM m WHERE inside GROUP BY seed, y),
            seen AS (SELECT seed, m.y, t, count(*) AS c FROM ex JOIN m USING (id) WHERE inside GROUP BY ALL),
            vocab AS (SELECT seed, t FROM (SELECT seed, t, sum(c) AS df FROM seen GROUP BY ALL)
                QUALIFY row_number() OVER (PARTITION BY seed ORDER BY df DESC, t) <= 40),
            par AS (SELECT v.seed, v.t, cls.y, (coalesce(c, 0) + 0.5::DOUBLE) / (n + 1.0::DOUBLE) AS p
                FROM vocab v JOIN cls USING (seed) LEFT JOIN seen s ON s.seed = v.seed AND s.t = v.t AND s.y = cls.y),
            base AS (SELECT cls.seed, cls.y, ci, ln(n::DOUBLE / total) AS prior, sum(ln(1 - p)) AS miss
                FROM cls JOIN par ON par.seed = cls.seed AND par.y = cls.y GROUP BY ALL),
            hit AS (SELECT id, par.seed, par.y, sum(ln(p) - ln(1 - p)) AS d FROM ex JOIN par USING (t) GROUP BY ALL),
            sc AS (SELECT m.id, m.seed, m.y AS truth, inside, b.y, ci, round(CASE WHEN d IS NULL THEN prior ELSE prior + miss + d END, 9) AS score
                FROM m JOIN base b ON b.seed = m.seed LEFT JOIN hit h ON h.id = m.id AND h.seed = m.seed AND h.y = b.y),
            pr AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY id, seed ORDER BY score DESC, ci) = 1)
            SELECT seed::INTEGER AS seed, count(*) FILTER (inside) AS train_rows, count(*) FILTER (NOT inside) AS val_rows,
                round(avg((y = truth)::INT) FILTER (inside), 6) AS train_acc, round(avg((y = truth)::INT) FILTER (NOT inside), 6) AS val_acc
            FROM pr GROUP BY seed""",
        "score_batch": nb_scores(conv, ["conv_id", "turn"], "text", "role", 40, 3),
        "score_stream": nb_scores(conv, ["conv_id", "turn"], "text", "role", 40, 3),
        "score_stream_restart": nb_scores(conv, ["conv_id", "turn"], "text", "role", 40, 3),
    }
