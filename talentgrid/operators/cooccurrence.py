"""Conditional co-occurrence by bit-sliced posting lists.

Equal postings of a role are one pattern with a weight. A bucket of a role's patterns is a matrix of bits, one row a
skill (its posting list); the weights are rows too, one for each binary digit (slices). A profile's relevant patterns
are the OR of the rows of its skills; the weighted number of those that hold another skill is the sum over the slices
of 2^digit times the bits that relevant patterns, that skill's row and the slice share. Where a pattern has few of the
skills, most words of bits are empty, so the posting lists are read as lists of places instead. No profile meets a pattern as
a row: a bucket of patterns is one packed row, and Spark deals each piece of a role's profiles, followed by the role's
buckets, to a task that adds counts up bucket by bucket and passes the result on. Counts are never shuffled or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.operators.tables import cut_plan, parquet_cut, with_totals

PATTERNS = 32768  #: patterns of one bucket: 4 KB a skill
NEEDS = 2048  #: profile lists of one group
BITS = 4  #: words of bits that are counted in the time of one entry of a list
OWNERS = 1024  #: profiles that share one list in a group; more are several lists
ROWS = 1 << 17  #: result rows of one record batch, about
_PACKED = "role string, bucket int, names array<string>, codes binary, sizes binary, jobs binary"


def packed(rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bits at (row, column), as rows of 64-bit words."""
    words = np.zeros((shape[0], (shape[1] + 63) // 64), np.uint64)
    np.bitwise_or.at(words, (rows, columns // 64), np.uint64(1) << (columns % 64).astype(np.uint64))
    return words


def slices(weights: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(value, bits) of every binary digit that some weight has."""
    out = []
    for digit in range(int(weights.max(initial=0)).bit_length()):
        at = np.flatnonzero(weights >> digit & 1)
        if len(at):
            out.append((1 << digit, packed(np.zeros(len(at), int), at, (1, len(weights)))[0]))
    return out


def _weighted(bits: np.ndarray, digits: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sum of the weights of the bits of each row."""
    return sum((value * np.bitwise_count(bits & s).sum(axis=-1, dtype=np.int64) for value, s in digits),
               np.zeros(bits.shape[:-1], np.int64))


def _pack(patterns: pa.Table) -> pa.Table:
    """The patterns of one bucket as one row: skill names, and 32-bit places in them, list after list."""
    lists = patterns.column("skills").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    return pa.Table.from_arrays([
        patterns.column("role").slice(0, 1), patterns.column("bucket").slice(0, 1), pa.array([coded.dictionary], pa.list_(pa.string())),
        *(pa.array([x.tobytes()], pa.binary()) for x in (
            coded.indices.to_numpy().astype(np.int32), lists.value_lengths().to_numpy().astype(np.int32),
            patterns.column("jobs").to_numpy().astype(np.int64)))],
        ["role", "bucket", "names", "codes", "sizes", "jobs"])


class _Bucket:
    """Patterns of one bucket: their skills as posting lists and, where these would be longer, as rows of bits."""

    def __init__(self, names: list[str], codes: bytes, sizes: bytes, jobs: bytes):
        self.codes, self.sizes, self.weights = np.frombuffer(codes, np.int32), np.frombuffer(sizes, np.int32), np.frombuffer(jobs, np.int64)
        self.n, self.here = len(names), {s: i for i, s in enumerate(names)}
        self.begins = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.posted = self.owner[np.argsort(self.codes, kind="stable")]
        self.lists = np.append(0, np.cumsum(np.bincount(self.codes, minlength=self.n)))
        self.each = len(self.codes) / max(len(self.sizes), 1)
        self.ones = bool((self.weights == 1).all())
        self.on = np.zeros(len(self.sizes), bool)

    @cached_property
    def bits(self) -> np.ndarray:
        return packed(self.codes, self.owner, (self.n, len(self.sizes)))

    @cached_property
    def digits(self) -> list[tuple[int, np.ndarray]]:
        return slices(self.weights)

    def counts(self, rows: list[int]) -> tuple[int, np.ndarray]:
        """Weight of the patterns that hold one of the skills, and of those among them that hold each skill."""
        least = sum(self.lists[r + 1] - self.lists[r] for r in rows) * self.each  # entries read by lists, about
        digits = int(self.weights.max(initial=0)).bit_length()
        return self._by_lists(rows) if least * BITS <= self.n * len(self.sizes) / 64 * digits else self._by_bits(rows)

    def _by_lists(self, rows: list[int]) -> tuple[int, np.ndarray]:
        for r in rows:
            self.on[self.posted[self.lists[r]:self.lists[r + 1]]] = True
        held = np.flatnonzero(self.on)
        self.on[held] = False
        size = self.sizes[held]
        at = np.arange(int(size.sum())) + np.repeat(self.begins[held] - (np.cumsum(size) - size), size)
        codes = self.codes[at]
        if self.ones:
            return len(held), np.bincount(codes, minlength=self.n)
        return int(self.weights[held].sum()), self._summed(codes, np.repeat(self.weights[held], size))

    def _summed(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums of whole numbers; in doubles where these hold them."""
        if float(weights.sum(dtype=np.float64)) < 1 << 52:
            return np.bincount(codes, weights, self.n).astype(np.int64)
        total = np.zeros(self.n, np.int64)
        np.add.at(total, codes, weights)
        return total

    def _by_bits(self, rows: list[int]) -> tuple[int, np.ndarray]:
        relevant = np.bitwise_or.reduce(self.bits[rows], axis=0)
        on = np.flatnonzero(relevant)  # words without a relevant pattern are left out
        part = [(value, s[on]) for value, s in self.digits]
        return int(_weighted(relevant[on], part)), _weighted(self.bits[:, on] & relevant[on], part)


class _Chunk:
    """Profile lists of one role, and their counts over the buckets met so far."""

    def __init__(self):
        self.needs: list[tuple[list[str], list]] = []  # owned skills, profiles
        self.place: dict[str, int] = {}
        self.relevant = np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []  # (places, counts) of each list

    def add(self, names: list[str], codes: bytes, sizes: bytes, jobs: bytes) -> None:
        """For each list of owned skills: the weight of the patterns that share one, and of those among them that
        hold each skill that is not owned."""
        if not self.held:
            self.relevant = np.zeros(len(self.needs), np.int64)
            self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.needs)
        bucket = _Bucket(names, codes, sizes, jobs)
        place = np.array([self.place.setdefault(s, len(self.place)) for s in names], np.int64)
        total = np.zeros(len(self.place), np.int64)
        for k, (owned, _) in enumerate(self.needs):
            rows = [bucket.here[s] for s in owned if s in bucket.here]
            if not rows:
                continue
            relevant, count = bucket.counts(rows)
            count[rows] = 0
            self.relevant[k] += relevant
            at, n = self.held[k]
            total[at] = n
            total[place] += count
            at = np.flatnonzero(total)
            self.held[k] = at, total[at]
            total[at] = 0

    def results(self, role: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(self.place), pa.string())
        ids, skills, shares, size = [], [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.repeat(pa.scalar(role, pa.string()), size), names.take(pa.array(np.concatenate(skills))),
                 pa.array(np.concatenate(shares))], ["profile_id", "target_role", "skill", "cooccurrence"])

        for (_, profiles), (at, n), relevant in zip(self.needs, self.held, self.relevant.tolist()):
            if not len(at):
                continue
            each = max(1, ROWS // len(at))
            for begin in range(0, len(profiles), each):
                some = pa.array(profiles[begin:begin + each], kind)
                ids.append(some.take(pa.array(np.repeat(np.arange(len(some)), len(at)))))
                skills.append(np.tile(at, len(some)))
                shares.append(np.tile(n / relevant, len(some)))
                size += len(some) * len(at)
                if size >= ROWS:
                    yield batch()
                    ids, skills, shares, size = [], [], [], 0
        if size:
            yield batch()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows stand by role and chunk: the lists of a chunk, then the buckets of its role."""
    chunk, now, kind = _Chunk(), None, None
    for b in batches:
        kind = b.schema.field("profiles").type.value_type.field(0).type
        for i in range(b.num_rows):
            row = {c: b.column(c)[i] for c in b.schema.names}
            group = row["role"].as_py(), row["chunk"].as_py()
            if group != now:
                if now is not None:
                    yield from chunk.results(now[0], kind)
                chunk, now = _Chunk(), group
            if row["bucket"].as_py() < 0:
                chunk.needs.append((row["owned"].as_py(), [p["profile_id"] for p in row["profiles"].as_py()]))
            else:
                chunk.add(*(row[c].as_py() for c in ("names", "codes", "sizes", "jobs")))
    if now is not None:
        yield from chunk.results(now[0], kind)


def _dealt(rows: DataFrame, key: str, each: int, name: str) -> DataFrame:
    """``name``: the piece of its role that a row is in, and ``pieces``: how many the role has."""
    sized = with_totals(rows, ["role"], F.ceil(F.count("*") / each).cast("int").alias("pieces"))
    return sized.withColumn(name, F.pmod(F.col(key), F.col("pieces")).cast("int"))


def conditional_cooccurrence(owned: DataFrame, posting_skills: DataFrame) -> DataFrame:
    """Per profile: P(skill | a posting of the target role shares an owned skill), of skills not owned.

    Profiles with the same role and skills are counted once; repeated rows count once, rows without a role or skill
    meet nothing.
    """
    kind = owned.schema["profile_id"].dataType.simpleString()
    keys = owned.where("target_role IS NOT NULL AND skill IS NOT NULL").groupBy("profile_id", F.col("target_role").alias("role")).agg(
        F.array_sort(F.collect_set("skill")).alias("owned"))
    keys = parquet_cut(keys.withColumn("need", F.xxhash64("role", "owned")), "profile-lists")
    # lists of many profiles are dealt as several
    parts = F.ceil(F.count("*") / OWNERS).cast("int")
    many = keys.groupBy("need").agg(parts.alias("parts")).where("parts > 1")
    shared = keys.join(many, "need", "left").withColumn("part", F.pmod(F.xxhash64("profile_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    needs = shared.groupBy("role", "need", "part").agg(
        F.first("owned").alias("owned"), F.collect_list(F.struct("profile_id")).alias("profiles"))
    needs = parquet_cut(_dealt(needs.withColumn("key", F.xxhash64("need", "part")), "key", NEEDS, "chunk"), "profile-chunks")
    patterns = posting_skills.where("role IS NOT NULL").groupBy("job_id", "role").agg(F.array_sort(F.collect_set("skill")).alias("skills")).groupBy(
        "role", "skills").agg(F.count("*").alias("jobs")).withColumn("pattern", F.xxhash64("role", "skills"))
    patterns = _dealt(parquet_cut(patterns, "patterns"), "pattern", PATTERNS, "bucket")
    buckets = cut_plan(patterns.groupBy("role", "bucket").applyInArrow(_pack, _PACKED))
    # each piece of a role's profiles meets each bucket of its patterns
    chunks = needs.groupBy("role").agg(F.first("pieces").alias("chunks"))
    met = buckets.join(chunks, "role").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    rows = needs.select("role", "chunk", F.lit(-1).alias("bucket"), "owned", "profiles").unionByName(met, allowMissingColumns=True)
    return rows.repartition("role", "chunk").sortWithinPartitions("role", "chunk", "bucket").mapInArrow(
        _count, f"profile_id {kind}, target_role string, skill string, cooccurrence double")
