"""State that later deliveries update: late and repeated rows, failures, and what an update reads."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from talentgrid.operators.history import MaintainedState, current_state
from talentgrid.streaming import ingest as ST

EVENTS = "ts string, kind string"


def counted(log):
    return {(str(r.period)[:10], r.kind): r.n for r in log.read().collect()}


def test_counts_of_deliveries_in_any_order(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "state"))
    log = ST.CountLog(spark, out, ["kind"])
    assert log.read() is None
    log.compact()
    deliveries = [["2024-03-20"] * 2, ["2024-03-01", "2024-03-21"], ["2024-03-01", "2023-01-01", None], ["2024-03-20"]]
    rows = []
    for n, days in enumerate(deliveries):
        rows += days
        spark.createDataFrame([(d, "a") for d in days] + [("2024-03-20", None)], EVENTS).coalesce(1).write.mode("append").parquet(src)
        ST.add_counts(ST.file_stream(spark, src, EVENTS), "ts", log, ck)
        want = Counter((d, "a") for d in rows if d) + Counter({("2024-03-20", None): n + 1})
        assert counted(log) == want
        if n % 2:
            log.compact()
            assert counted(log) == want
    assert log.base() == 3
    assert log._parts() == [f"{out}/bases/upto=3"]


def test_a_repeated_batch_counts_once(spark, tmp_path):
    log = ST.CountLog(spark, str(tmp_path / "out"), ["kind"])

    def rows(*days):
        return ST.period_counts(spark.createDataFrame([(d, "a") for d in days], EVENTS), "ts", "kind")

    log.add(rows("2024-01-01"), 0)
    log.add(rows("2024-01-01", "2024-01-02"), 1)
    log.add(rows("2024-01-01", "2024-01-02"), 1)  # the stream failed after the write and runs its batch again
    want = {("2024-01-01", "a"): 2, ("2024-01-02", "a"): 1}
    assert counted(log) == want
    log.compact()
    log.add(rows("2024-01-01", "2024-01-02"), 1)  # the same after a compaction that took the batch in
    log.add(rows("2024-01-01"), 0)
    assert counted(log) == want
    # a write that was cut off has no mark of its end and counts nowhere
    rows("2024-01-05").write.parquet(f"{log.path}/deltas/batch=2")
    (tmp_path / "out/deltas/batch=2/_SUCCESS").unlink()
    rows("2024-01-05").write.parquet(f"{log.path}/bases/upto=9")
    (tmp_path / "out/bases/upto=9/_SUCCESS").unlink()
    assert counted(log) == want
    log.add(rows("2024-01-03"), 2)
    assert counted(log) == {**want, ("2024-01-03", "a"): 1}


GROUPS = {"extract": ["user", "k"], "pivot": ["score"]}
LOG = "id string, updated_at int, stage string, user string, k string, score double"
ENTRIES = [("a", 1, "extract", "u", "x", None), ("a", 3, "pivot", None, None, 1.0), ("b", 2, "extract", "v", None, None),
           ("c", 2, "pivot", None, None, 2.0), (None, 5, "extract", "w", "z", None), ("d", 1, "extract", "u", "q", None),
           ("a", 2, "extract", "u2", "y", None), ("b", 4, "deleted", None, None, None), ("a", 2, "pivot", None, None, 9.0),
           ("d", 1, "extract", "u", "r", None), ("e", 1, None, "u", "q", None), ("d", 9, "other", None, None, None)]


def values(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("cuts", [[12], [1, 5, 12], [6, 7, 8, 12]])
def test_state_equals_the_whole_log(spark, tmp_path, cuts):
    state = MaintainedState(spark, str(tmp_path / "s"), GROUPS, buckets=4)
    assert state.current() is None
    assert state.update(spark.createDataFrame([], LOG)) == []
    begin = 0
    for end in cuts:
        state.update(spark.createDataFrame(ENTRIES[begin:end], LOG))
        begin = end
        assert values(state.current()) == values(current_state(spark.createDataFrame(ENTRIES[:end], LOG), GROUPS))
    want = values(current_state(spark.createDataFrame(ENTRIES, LOG), GROUPS))
    state.update(spark.createDataFrame(ENTRIES[3:9], LOG))  # an update that is repeated
    assert values(state.current()) == want
    backwards = MaintainedState(spark, str(tmp_path / "b"), GROUPS, buckets=4)
    for e in ENTRIES[::-4]:
        backwards.update(spark.createDataFrame([e], LOG))
    backwards.update(spark.createDataFrame(ENTRIES, LOG))
    assert values(backwards.current()) == want


def test_an_update_reads_and_writes_touched_buckets_only(spark, tmp_path):
    state = MaintainedState(spark, str(tmp_path / "s"), GROUPS, buckets=8)
    many = spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("updated_at"), F.lit("pivot").alias("stage"),
                                   F.lit(None).cast("string").alias("user"), F.lit(None).cast("string").alias("k"), F.lit(1.0).alias("score"))
    assert state.update(many) == []
    before = state.files()
    assert len(before) == 8
    read = state.update(spark.createDataFrame([("7", 2, "pivot", None, None, 5.0)], LOG))
    assert len(read) == 1 and read[0] in before
    after = state.files()
    assert len(set(after) & set(before)) == 7
    assert len(list((tmp_path / "s/rows/v=2").glob("bucket=*"))) == 1
    assert {r.id: r.pivot_score for r in state.current().collect()} == {str(i): 5.0 if i == 7 else 1.0 for i in range(200)}
    # a cut-off update: files without a list
    (tmp_path / "s/lists/v=2/_SUCCESS").unlink()
    assert state.files() == before and state.current().where("id = '7'").first().pivot_score == 1.0
    state.update(spark.createDataFrame([("7", 2, "pivot", None, None, 5.0)], LOG))
    assert state.current().where("id = '7'").first().pivot_score == 5.0
