"""Operator 11: a Merkle manifest of a table's rows, one column per child of a parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import numbered, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# nodes whose common ancestor is found without another shuffle
SPAN = 64


def field(c: Column) -> Column:
    """``-`` for null, else the value's UTF-8 bytes, counted."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to by the siblings of a path."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings(path: Column) -> Column:
    """The siblings of a path from the leaf upwards, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def trees(nodes: DataFrame, fanout: int, name: str) -> DataFrame:
    """Nodes (tree, place from 0, n nodes of the tree, h, item) -> (tree, item, path, root).

    ``path`` holds per level what stands before and after the node's own digest in
    its parent's hash. Levels rise in runs: rows are dealt once by (tree, place div
    span), and within a run each parent is one conditional aggregate per child, the
    columns of its children side by side. All columns are its hash; all but a
    child's own are that child's siblings. A row holds ``span`` leaves at most, and
    the table of the next run is smaller by that factor.
    """
    levels, span = 1, fanout
    while span * fanout <= SPAN:
        levels, span = levels + 1, span * fanout
    most = nodes.agg(F.max("n")).first()[0] or 1
    runs = []
    while True:
        runs.append(written(_rise(nodes, fanout, levels, span), f"{name}-{len(runs)}"))
        most = -(-most // span)
        if most == 1:
            break
        nodes = runs[-1].select("tree", F.col("block").alias("place"), "n", "h", F.col("block").alias("item"))
    done = runs.pop().select("tree", F.col("h").alias("root"), F.explode("below").alias("x"))
    done = done.select("tree", "root", F.col("x.item").alias("item"), F.col("x.path").alias("path"))
    for run in reversed(runs):
        above = done.select(F.col("tree").alias("_t"), F.col("item").alias("_b"), F.col("path").alias("_up"), "root")
        met = run.join(above, (F.col("tree") == F.col("_t")) & (F.col("block") == F.col("_b")))
        met = met.select("tree", "root", "_up", F.explode("below").alias("x"))
        done = met.select("tree", "root", F.col("x.item").alias("item"), F.concat("x.path", "_up").alias("path"))
    return done.select("tree", "item", "path", "root")


def _rise(nodes: DataFrame, fanout: int, levels: int, span: int) -> DataFrame:
    """(tree, block, n, h, below): the nodes after some levels with all rows below them and their paths so far."""
    slots = range(fanout)
    start = F.array().cast("array<struct<before:string,after:string>>")
    below = F.array(F.struct(F.col("item"), start.alias("path")))
    at = nodes.select("tree", F.expr(f"place div {span}").alias("block"), "place", "n", "h", below.alias("below"))
    at = at.repartition("tree", "block")
    for _ in range(levels):
        slot = F.col("place") % fanout
        children = [F.max(F.when(slot == s, F.col("h"))).alias(f"h{s}") for s in slots]
        rows = [F.first(F.when(slot == s, F.col("below")), ignorenulls=True).alias(f"b{s}") for s in slots]
        up = at.groupBy("tree", "block", "n", F.expr(f"place div {fanout}").alias("place")).agg(*children, *rows)
        # a lone node is a root and rises as it is; the new count has another name, as lambdas would read it for n
        many = F.col("n") > 1
        h = [F.coalesce(f"h{s}", F.lit("")) for s in slots]
        paths = []
        for s in slots:
            own = F.struct(F.concat(F.lit(""), *h[:s]).alias("before"), F.concat(F.lit(""), *h[s + 1 :]).alias("after"))
            step = F.when(many, F.array(own)).otherwise(start)
            paths.append(_longer(F.col(f"b{s}"), step))
        kept = F.concat(*[F.coalesce(p, F.array().cast(at.schema["below"].dataType)) for p in paths])
        at = up.select(
            "tree", "block", "place", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("left"),
            F.when(many, F.sha2(F.concat(*h), 256)).otherwise(F.col("h0")).alias("h"), kept.alias("below"),
        ).withColumnRenamed("left", "n")
    return at.drop("place")


def _longer(rows: Column, step: Column) -> Column:
    return F.transform(rows, lambda x: F.struct(x["item"].alias("item"), F.concat(x["path"], step).alias("path")))


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields=FIELDS, fanout: int = 2,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: its id, its group, leaf, path, subroot and root, and the columns of ``keep``.

    A row's leaf is the hash of ``fields``. The leaves of a group ascend by id;
    while several nodes are left, every ``fanout`` consecutive ones are hashed to
    one, the last run with fewer. What is left is the group's subroot. Subroots by
    group (null first, bytewise) lead to the root the same way. ``path`` runs from
    the leaf through the subroot to the root.

    Null values are fields of their own kind; null ids come first, a null group is
    a group. Rows of equal id ascend by leaf; equal rows in any order, which gives
    the same hashes. Empty and very long texts are whole fields. No rows: none.
    Only ``fields``, the id, the group and ``keep`` are read, so other columns may
    have any name.
    """
    keep = keep or {}
    slim = docs.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf(*[F.col(c) for c in fields]).alias("leaf"),
        F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in keep.items()]).alias("kept"),
    )
    slim = written(slim, "merkle-leaves")
    # equal rows may be many: the last key spreads them over ranges
    spread = F.xxhash64(F.monotonically_increasing_id())
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    placed = numbered(slim.withColumn("tie", spread), order, "at", "merkle-order").drop("tie")
    per = written(placed.groupBy("grp").agg(F.min("at").alias("tree"), F.count(F.lit(1)).alias("n")), "merkle-groups")
    groups = per.withColumnRenamed("grp", "_g")
    item = F.struct("id", "leaf", "kept").alias("item")
    nodes = placed.join(groups, placed["grp"].eqNullSafe(groups["_g"]))
    nodes = nodes.select("tree", (F.col("at") - F.col("tree")).alias("place"), "n", F.col("leaf").alias("h"), item)
    low = trees(nodes, fanout, "merkle-low").withColumnRenamed("root", "subroot")
    roots = low.groupBy("tree").agg(F.first("subroot").alias("h"))
    ranked = numbered(roots, [F.col("tree")], "place", "merkle-roots")
    many = per.count()
    high = ranked.select(F.lit(0).cast("long").alias("tree"), "place", F.lit(many).cast("long").alias("n"), "h", F.col("tree").alias("item"))
    high = trees(high, fanout, "merkle-high").select(F.col("item").alias("_tree"), F.col("path").alias("_up"), "root")
    high = high.join(per, F.col("_tree") == per["tree"]).drop("tree", "n")
    out = low.join(high, F.col("tree") == F.col("_tree"))
    return out.select(
        F.col("item.id").alias(id_col), F.col("grp").alias(group_col), F.col("item.leaf").alias("leaf"),
        F.concat("path", "_up").alias("path"), "subroot", "root", *[F.col(f"item.kept.{k}").alias(k) for k in keep],
    )


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: proofs, and roots recomputed after tampering with each seventh row's ``n_chars``."""
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(1)).otherwise(F.lit(0))
    changed = leaf(*[F.try_add("n_chars", more) if c == "n_chars" else F.col(c) for c in FIELDS])
    m = manifest(docs, keep={"changed": changed})
    m = m.withColumn("folded_root", fold(F.col("changed"), F.col("path")))
    return m.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = " || ".join(_FIELD.format(c) for c in FIELDS)
SQL = f"""
WITH RECURSIVE
c AS (SELECT row_number() OVER () AS rid, *, list_reduce(
        list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT),
        lambda crc, b: list_reduce(range(8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295) AS crc
      FROM documents),
l AS (SELECT rid, doc_id, lang, sha256({_LEAF}) AS leaf,
             sha256({_LEAF.replace("n_chars", "(n_chars + coalesce((xor(crc, 4294967295) % 7 = 0)::INT, 0))")}) AS changed FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
             count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM l),
nodes(tree, level, place, n, h) AS (
      SELECT tree, 0, place, n, leaf FROM p
      UNION ALL SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place))
                FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2, n),
tops(level, place, n, h) AS (
      SELECT 0, tree, (SELECT count(*) FROM nodes WHERE n = 1), h FROM nodes WHERE n = 1
      UNION ALL SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place))
                FROM tops WHERE n > 1 GROUP BY level, place // 2, n),
s AS (SELECT rid, v.level AS step, (p.place >> v.level) & 1 AS side, coalesce(x.h, '') AS sib
      FROM p JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) v USING (tree)
      LEFT JOIN nodes x ON x.tree = p.tree AND x.level = v.level AND x.place = xor(p.place >> v.level, 1)
      UNION ALL
      SELECT rid, 100 + v.level, (p.tree >> v.level) & 1, coalesce(x.h, '')
      FROM p, (SELECT DISTINCT level FROM tops WHERE n > 1) v
      LEFT JOIN tops x ON x.level = v.level AND x.place = xor(p.tree >> v.level, 1)),
o AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY step) AS k FROM s),
f(rid, k, h) AS (
      SELECT rid, 0::BIGINT, changed FROM p
      UNION ALL SELECT f.rid, o.k, sha256(CASE WHEN side = 0 THEN h || sib ELSE sib || h END) FROM f JOIN o ON o.rid = f.rid AND o.k = f.k + 1),
z AS (SELECT rid, arg_max(h, k) AS folded_root FROM f GROUP BY rid),
q AS (SELECT p.rid, sha256(coalesce(string_agg(sib, '' ORDER BY step), '')) AS proof_sha256 FROM p LEFT JOIN s USING (rid) GROUP BY ALL)
SELECT doc_id, leaf, r.h AS subroot, t.h AS root, proof_sha256, folded_root, folded_root = t.h AS verified
FROM p JOIN nodes r ON r.tree = p.tree AND r.n = 1 JOIN q USING (rid) JOIN z USING (rid) JOIN tops t ON t.n = 1
"""
