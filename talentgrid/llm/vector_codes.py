"""Compression of vectors to one codebook entry a part, with a GNAT over the entries of each part.

Vectors are whole numbers, floor(scale * x), cut into equal parts; every part position has its own codebook. A round
assigns each part to its nearest entry and moves each entry to the floored mean of its parts. Tasks return sums and
counts of the entries, a table whose size depends on the codebooks only; the vectors stay where they are.

Nearest entries are found in a GNAT (geometric near-neighbour access tree): a node has a few split points and keeps,
for each split point and each child, the range of distances from that point to the entries of that child. For a
query at known distances from the split points, a child whose range cannot meet the sphere of the best distance so
far is left out with its whole subtree. Only strictly worse subtrees are left out: square roots are rounded against
elimination, and candidates are compared by integer squared distances, then by index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.shared import settled

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
DEGREE = 4  #: split points of a node
LEAF = 3  #: entries of a node without split points
LARGEST = 1 << 62  #: magnitude at which whole numbers stop
SALTS = 16  #: tasks that share the rows of one label
_ULP = 2.0**-50  #: relative margin, above the rounding of a root and a sum
_LONG = 2**63 - 1


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer squared distances of rows of ``a`` to ``b``; exact also for arrays of Python integers."""
    d = a - b
    return (d * d).sum(axis=1)


def _root(squares, up: bool) -> np.ndarray:
    return np.sqrt(np.asarray(squares, np.float64)) * (1 + _ULP if up else 1 - _ULP)


class Node:
    """A node over ``rows`` (indexes of entries): a leaf, or split points with the ranges of their children."""

    def __init__(self, entries: np.ndarray, rows: list[int], degree: int = DEGREE, leaf: int = LEAF):
        self.leaf, self.splits, self.children = rows, [], []
        if len(rows) <= leaf:
            return
        splits = [rows[0]]
        near = squared(entries[rows], entries[rows[0]])
        while len(splits) < degree and near.max() > 0:  # spread: each next point is the farthest from those before
            splits.append(rows[int(near.argmax())])
            near = np.minimum(near, squared(entries[rows], entries[splits[-1]]))
        if len(splits) < 2:  # equal entries
            return
        apart = np.array([squared(entries[rows], entries[s]) for s in splits])
        home = apart.argmin(axis=0)
        self.leaf, self.splits = [], splits
        groups = [[i for i in range(len(rows)) if home[i] == j] for j in range(len(splits))]
        self.low = np.array([[_root(a[g].min(), False) for g in groups] for a in apart])
        self.high = np.array([[_root(a[g].max(), True) for g in groups] for a in apart])
        self.children = [Node(entries, [rows[i] for i in g if rows[i] != s], degree, leaf)
                         for g, s in zip(groups, splits)]


class Gnat:
    """Nearest entries of many queries; ``pairs`` counts the distances that were computed."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE, leaf: int = LEAF):
        self.entries, self.pairs = entries, 0
        self.top = Node(entries, list(range(len(entries))), degree, leaf)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lower one of ties, and the integer squared distance."""
        self.index = np.full(len(queries), len(self.entries), np.int64)
        self.best = np.full(len(queries), _LONG, queries.dtype)
        if queries.dtype == object:
            self.best = np.array([1 << 200] * len(queries), object)
        self._visit(self.top, queries, np.arange(len(queries)))
        return self.index, self.best

    def _meet(self, queries: np.ndarray, rows: np.ndarray, entry: int) -> np.ndarray:
        found = squared(queries[rows], self.entries[entry])
        self.pairs += len(rows)
        best = self.best[rows]
        better = (found < best) | ((found == best) & (entry < self.index[rows]))
        self.best[rows[better]] = found[better]
        self.index[rows[better]] = entry
        return found

    def _visit(self, node: Node, queries: np.ndarray, rows: np.ndarray) -> None:
        for entry in node.leaf:
            self._meet(queries, rows, entry)
        if not node.splits:
            return
        met = np.array([self._meet(queries, rows, s) for s in node.splits])
        low, high = _root(met, False), _root(met, True)
        for j, child in enumerate(node.children):
            if not child.leaf and not child.splits:
                continue
            radius = _root(self.best[rows], True)
            on = np.ones(len(rows), bool)
            for i in range(len(node.splits)):
                on &= low[i] <= (node.high[i, j] + radius) * (1 + _ULP)
                on &= (high[i] + radius) * (1 + _ULP) >= node.low[i, j]
            if on.any():
                self._visit(child, queries, rows[on])


def bounds(width: int, parts: int) -> list[tuple[int, int]]:
    """First and last component of each part; equal parts where the width allows."""
    return [(i * width // parts, (i + 1) * width // parts) for i in range(parts)]


class Codebooks:
    """Entries of every part position: ``entries[part]`` is a list of lists of integers."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries
        flat = [abs(x) for part in entries for e in part for x in e]
        self.most = max(flat, default=0)
        self.trees: dict[type, list[Gnat]] = {}

    def digest(self) -> str:
        text = ",".join(str(x) for part in self.entries for e in part for x in e)
        return hashlib.sha256(text.encode()).hexdigest()

    def kind(self, vectors: np.ndarray) -> type:
        """64-bit integers where no squared distance can exceed them, else Python integers."""
        most = max(self.most, int(np.abs(vectors).max(initial=0)))
        return np.int64 if 4 * most * most * max(vectors.shape[1], 1) <= _LONG else object

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Index of the entry of each part (rows x parts) and the squared distances, part by part."""
        kind = self.kind(vectors)
        if kind not in self.trees:
            self.trees[kind] = [Gnat(np.array(part, kind)) for part in self.entries]
        codes = np.zeros((len(vectors), len(self.entries)), np.int64)
        errors = []
        for p, (a, b) in enumerate(bounds(vectors.shape[1], len(self.entries))):
            codes[:, p], error = self.trees[kind][p].nearest(vectors[:, a:b].astype(kind))
            errors.append(error)
        return codes, errors


def _whole(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Rows whose vectors are whole and finite; components as 64-bit integers."""
    for given in batches:
        vectors = given.column("vector")
        values = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
        sizes = vectors.value_lengths().fill_null(0).to_numpy()
        good = np.isfinite(values)
        ends = np.cumsum(sizes)
        before = np.concatenate([[0], np.cumsum(good)])
        kept = np.flatnonzero((before[ends] - before[ends - sizes] == sizes) & (sizes > 0))
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(np.where(good, values, 0) * scale), -LARGEST, LARGEST).astype("<i8")
        rows = given.take(pa.array(kept))
        yield pa.RecordBatch.from_arrays(
            [rows.column("id"), rows.column("label"), pa.array(sizes[kept], pa.int32()),
             pa.array([whole[e - n:e].tobytes() for e, n in zip(ends[kept], sizes[kept])], pa.binary())],
            ["id", "label", "width", "whole"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def _sums(batches: Iterator[pa.RecordBatch], books: Codebooks, width: int) -> Iterator[pa.RecordBatch]:
    """Sum and number of the parts of every entry that has any, component by component."""
    sums: dict[tuple[int, int], list] = {}
    for given in batches:
        vectors = _matrix(given.column("whole"), width)
        codes, _ = books.assign(vectors)
        for p, (a, b) in enumerate(bounds(width, len(books.entries))):
            order = np.argsort(codes[:, p], kind="stable")
            found, first, counts = np.unique(codes[order, p], return_index=True, return_counts=True)
            block = vectors[order, a:b]
            if block.size and int(np.abs(block).max()) > _LONG // len(block):
                block = block.astype(object)
            for entry, total, n in zip(found.tolist(), np.add.reduceat(block, first, axis=0).tolist(), counts.tolist()):
                old = sums.setdefault((p, entry), [0, [0] * (b - a)])
                old[0] += n
                old[1] = [x + y for x, y in zip(old[1], total)]
    rows = [(p, e, i, n, Decimal(x)) for (p, e), (n, total) in sums.items() for i, x in enumerate(total)]
    columns = list(zip(*rows)) or [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                     ["part", "entry", "place", "n", "total"])


def _codes(batches: Iterator[pa.RecordBatch], books: Codebooks, width: int) -> Iterator[pa.RecordBatch]:
    for given in batches:
        codes, errors = books.assign(_matrix(given.column("whole"), width))
        text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
        totals = [min(sum(map(int, row)), _LONG) for row in zip(*errors)]
        yield pa.RecordBatch.from_arrays([given.column("id"), given.column("label"), pa.array(text, pa.string()),
                                          pa.array(totals, pa.int64())], ["id", "label", "code", "error"])


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, int]:
    """Codebooks after ``rounds`` rounds over ``kept`` (``id``, ``width``, ``whole``) and the width of the vectors.

    The first vectors by id (null ids last, equal ids by their components) give the first entries.
    """
    order = [F.col("id").asc_nulls_last(), "width", "whole"]
    first = kept.select("id", "width", "whole").orderBy(*order).limit(1).collect()
    if not first:
        return Codebooks([[] for _ in range(parts)]), 0
    width = first[0].width
    kept = kept.where(F.col("width") == width)
    seeds = kept.select("id", "width", "whole").orderBy(*order).limit(entries).collect()
    start = np.array([np.frombuffer(r.whole, "<i8") for r in seeds])
    books = Codebooks([start[:, a:b].tolist() for a, b in bounds(width, parts)])
    for _ in range(rounds):
        sums = kept.select("whole").mapInArrow(
            lambda it, books=books: _sums(it, books, width),
            "part int, entry int, place int, n long, total decimal(38,0)")
        new = [[list(e) for e in part] for part in books.entries]
        means = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for r in means.collect():  # one row a component of the codebooks
            new[r.part][r.entry][r.place] = int(r.total) // r.n
        books = Codebooks(new)
    return books, width


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id``, ``label``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every kept vector.

    ``code``: index of the entry of each part, two hex digits each. ``error``: squared distances summed over the
    parts; ``label_error``: summed over equal labels, nulls together; both end at the largest long. Left out are
    vectors that are null or empty, hold a null or a value that is not finite, or differ in length from the kept
    vector of the smallest id. Components end at ``LARGEST``. A width that ``parts`` does not divide gives parts of
    nearly equal width. Repeated ids and vectors are rows of their own, null ids never come before others as first
    entries, fewer than ``entries`` vectors give fewer entries, no rows give no rows. Other columns are left out.
    """
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"),
                          vectors[vector_col].alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    kept = settled(rows.mapInArrow(
        lambda it: _whole(it, scale), f"id {kinds['id']}, label {kinds['label']}, width int, whole binary"), "vectors")
    books, width = fit(kept, parts, entries, rounds)
    coded = settled(kept.where(F.col("width") == width).select("id", "label", "whole").mapInArrow(
        lambda it: _codes(it, books, width),
        f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy("label").agg(F.least(total, F.lit(Decimal(_LONG))).cast("long").alias("label_error"))
    # rows of one label may be a third of all: they meet copies of its sum in several tasks
    sums = sums.select(F.col("label").alias("of"), "label_error",
                       F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("copy"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code", "error"), F.lit(SALTS)).cast("int"))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("copy"))).select(
        "id", "label", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle(table: str = "embeddings", width: int = 64, parts: int = PARTS, entries: int = ENTRIES,
           rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same result in SQL, by comparing every part with every entry."""
    w = width // parts
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(x::DOUBLE * {scale}) AS BIGINT) for x in embedding] AS q
  FROM {table} WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""x AS MATERIALIZED (SELECT vec_id, p.part, q[p.part * {w} + 1:p.part * {w} + {w}] AS q FROM v, range({parts}) AS p(part))""",
        f"""c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, q FROM x
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))""",
    ]
    distance = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x.q, c.q)])"
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, [d, entry]) AS entry, min(d) AS d
  FROM (SELECT x.vec_id, x.part, c.entry, CAST({distance} AS BIGINT) AS d FROM x JOIN c{i} c ON c.part = x.part)
  GROUP BY vec_id, part)""")
        if i < rounds:
            means = ", ".join(f"CAST(floor(sum(q[{k + 1}]) / count(*)) AS BIGINT)" for k in range(w))
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN
  (SELECT part, entry, [{means}] AS q FROM a{i} JOIN x USING (vec_id, part) GROUP BY part, entry) m
  ON m.part = c.part AND m.entry = c.entry)""")
    return f"""WITH {', '.join(steps)},
r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM r JOIN v USING (vec_id)"""
