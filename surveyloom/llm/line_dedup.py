"""Operator 4: line dedup by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.runs import without_runs


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """Removes every line that a later occurrence of a repeated window covers.

    A window is ``window`` consecutive lines, compared after trimming spaces.
    Of equal windows in all documents the first, by id, then hash of the text,
    then position, keeps its lines; those of all others go, and overlapping
    windows go as one. Returns all rows and columns, and n_lines and n_removed.

    Null text: stays null, no lines. Empty text: one line. Fewer lines than a
    window: nothing goes. A window of blank lines only is none. Rows equal in id
    and text are one document: they keep or lose the same lines. A null id comes
    before all others. Other columns are passed on; columns named n_lines or
    n_removed are replaced.
    """
    return without_runs(
        docs, id_col, text_col, lambda t: F.split(t, "\n", -1), "\n", window, count="n_lines",
        removed="n_removed",
    )


SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, p, [trim(l[p + 1], ' '), trim(l[p + 2], ' '), trim(l[p + 3], ' ')] AS run
      FROM (SELECT doc_id, text, l, unnest(range(0, len(l) - 2)) AS p FROM d)),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, p) AS k
      FROM w WHERE run <> ['', '', '']),
c AS (SELECT DISTINCT doc_id, p + o AS p FROM f, (VALUES (0), (1), (2)) v(o) WHERE k > 1),
u AS (SELECT doc_id, unnest(range(0, len(l))) AS p, unnest(l) AS line FROM d),
k AS (SELECT u.doc_id, count(*) AS n_lines, count(c.p) AS n_removed,
             coalesce(string_agg(u.line, chr(10) ORDER BY u.p) FILTER (WHERE c.p IS NULL), '') AS text
      FROM u LEFT JOIN c ON u.doc_id IS NOT DISTINCT FROM c.doc_id AND u.p = c.p GROUP BY u.doc_id)
SELECT doc_id, text, n_lines, n_removed FROM k
UNION ALL SELECT doc_id, text, 0, 0 FROM documents WHERE text IS NULL
"""
