"""Operator 6: substring dedup by sliding spans of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.runs import without_runs

# A sentence ends after . ! or ? and one white space, or after a line break.
_ENDS = r"(?<=[.!?]\s)|(?<=\n)"


def dedup_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int = 2, min_words: int = 12
) -> DataFrame:
    """Removes the sentences that any non-first occurrence of a repeated span covers.

    A span is a run of ``sentences`` consecutive sentences with at least
    ``min_words`` words together, compared after trimming. The first by id, hash
    of the text and position stays. Returns all rows and columns, and
    n_sentences, n_removed and removed (numbers of the removed sentences, from
    0). What stays is joined as it stood, white space included.

    Null text: stays null, no sentences. Empty text: one empty sentence. Rows
    equal in id and text are one document. A null id comes before all others.
    Columns named like the three new ones are replaced.
    """
    return without_runs(
        docs, id_col, text_col, lambda t: F.split(t, _ENDS, -1), "", sentences, min_words,
        unit=lambda x: F.btrim(x, F.lit(" \t\r\n")), count="n_sentences",
        removed="n_removed", spans="removed",
    )
