"""Removal of word windows that occur more than once, by a count-min prefilter and exact grouping.

Every task counts the anchors of its windows in a sketch; the merged sketches overestimate
how often a window occurs (a window occurs at most as often as its anchor, an anchor at most
as often as its cell). Only windows estimated repeated are grouped exactly, so none is lost;
windows are compared by two independent 64-bit hashes. All judging is on the input.

Defined cases: null and empty texts have no words; texts shorter than a window lose none;
rows that repeat id and text are documents of their own and lose every full window; a null
id is passed through; an empty table gives no rows. Other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.llm import repeats
from massif.llm.repeats import Unit

WINDOW = 35


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, n_spans, kept_sha256, kept (UTF-8; where words went and ``keep_text``)."""
    unit = Unit(True, (window + 1) // 2, window)
    keyed = repeats.keyed(docs, id_col, text_col)
    scanned = repeats.scan(keyed, unit)
    texts = repeats.suspects(keyed, scanned)
    sure, open_ = repeats.contexts(repeats.occurrences(texts, unit))
    runs = sure.unionByName(repeats.open_windows(texts, open_, unit))
    out = repeats.finish(scanned, texts, runs, unit, keep_text)
    return out.select(F.col("id").alias(id_col), F.col("n_units").alias("n_words"), "n_removed", "n_spans", "kept_sha256", "kept")
