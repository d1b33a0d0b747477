"""Quality classifier: statistics of whole texts, scored by histogram gradient-boosted trees.

Training takes a bounded sample of labelled rows (``max_rows``, those with the smallest hash of their id):
their statistics, a few numbers a row, are fitted on the driver and the trees travel with the tasks. Scoring
runs in the rows' own partitions, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.boosting import Trees, fit
from talentgrid.llm.shared import picked

MAX_ROWS = 20_000
FEATURES = ("characters words unique_words repeated_neighbours word_length longest_word short_words lines "
            "unique_lines line_length line_ends upper digits stops exclamations marks symbols bars blanks "
            "breaks beyond_ascii entropy sentence_words").split()


def _share_of(signs: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[np.frombuffer(signs, np.uint8)] = 1
    return out


_SETS = np.stack([_share_of(s) for s in (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b"!", b"?;:'\"()-", b"#$%&*@^~<>{}[]\\_+=/", b"|", b" \t",
    b"\n\r", bytes(range(128, 256)))], axis=1)


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text, in the order of ``FEATURES``; null is the empty text."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(len(FEATURES))
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / len(raw)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n, m = max(len(words), 1), max(len(lines), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen = share[share > 0]
    ends = sum(counts[ord(c)] for c in ".!?")
    out[:] = (
        np.log1p(len(raw)), np.log1p(len(words)), len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        lengths.sum() / n, np.log1p(lengths.max(initial=0)), (lengths <= 3).sum() / n, np.log1p(len(lines)),
        len(set(lines)) / m, np.log1p(len(raw) / m), sum(x[-1:] in (b".", b"!", b"?") for x in lines) / m,
        *(share @ _SETS), -(seen * np.log2(seen)).sum(), np.log1p(n / max(ends, 1)),
    )
    return out


def _features_of(texts: pa.Array) -> np.ndarray:
    return np.stack([features(t.as_py()) for t in texts]) if len(texts) else np.zeros((0, len(FEATURES)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = pa.array(list(_features_of(b.column("text"))), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column("y"), rows], ["y", "x"])


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_rows: int = MAX_ROWS) -> Trees:
    """Fit on at most ``max_rows`` labelled documents that are not held out. Rows with a null id or a label
    other than 0 and 1 are not used; no labels, or one class, give a constant score.
    """
    rows = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y"))
    rows = rows.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    rows = rows.orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    sample = picked(docs, id_col, text_col).join(F.broadcast(rows), "id").select("y", "text")
    got = sample.mapInArrow(_measured, "y int, x array<double>").limit(max_rows).toArrow()  # ids may repeat
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(got.column("y").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the order of rows from the cluster does not count
    return fit(x[order], y[order])


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score`` (probability of quality 1) of every row; a null or empty text gets a score too."""
    rows = picked(docs, id_col, text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = trees.scores(_features_of(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s, pa.float64())], ["id", "score"])

    return rows.mapInArrow(scored, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text scores ``at_least``."""
    place = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(trees.scores(_features_of(b.column(place))) >= at_least))

    return docs.mapInArrow(kept, docs.schema)
