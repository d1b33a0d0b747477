"""Enrichment whose rows may fail and whose run may stop."""

import shutil

from pyspark.sql import functions as F

from talentgrid.sources import sinks


def test_rows_fail_alone_and_a_restart_repeats_no_batch(spark, tmp_path):
    def fragile(text):
        if text is None:
            return None
        if text.startswith("bad"):
            raise KeyError(text)
        return text.upper()

    out = str(tmp_path / "out")
    df = spark.createDataFrame([(i, f"bad{i}" if i % 7 == 0 else f"t{i}") for i in range(60)] + [(None, "n"), (5, "t5"), (61, None)],
                               "id long, text string")
    assert sinks.enrich_by_attempts(df, "id", "text", "value", fragile, out, batches=5) == 5
    rows = spark.read.parquet(out).collect()
    want = [(r.id, r.text if not r.text or r.text.startswith("bad") else r.text.upper(),
             f"KeyError: '{r.text}'" if r.text and r.text.startswith("bad") else None) for r in df.collect()]
    assert sorted(map(repr, ((r.id, r.value, r.value_error) for r in rows))) == sorted(map(repr, want))
    # a crash: one batch cut off while it was written, one never begun
    (tmp_path / "out/batch=2/_SUCCESS").unlink()
    shutil.rmtree(tmp_path / "out/batch=4")
    kept = {p.name for p in (tmp_path / "out/batch=1").iterdir()}
    assert sinks.enrich_by_attempts(df, "id", "text", "value", fragile, out, batches=5) == 2
    assert {p.name for p in (tmp_path / "out/batch=1").iterdir()} == kept
    again = spark.read.parquet(out).collect()
    assert sorted(map(repr, ((r.id, r.value, r.value_error) for r in again))) == sorted(map(repr, want))
    assert sinks.enrich_by_attempts(df, "id", "text", "value", fragile, out, batches=5) == 0


def test_a_second_attempt_may_succeed(spark, tmp_path):
    def flaky(text, seen=set()):
        if text not in seen:
            seen.add(text)
            raise TimeoutError("slow")
        return text + "!"

    out, df = str(tmp_path / "out"), spark.range(6).select("id", F.col("id").cast("string").alias("text"))
    sinks.enrich_by_attempts(df, "id", "text", "value", flaky, out, batches=2)
    assert {(r.text, r.value, r.value_error) for r in spark.read.parquet(out).collect()} == {(str(i), f"{i}!", None) for i in range(6)}
    assert sinks.enrich_by_attempts(df.limit(0), "id", "text", "value", flaky, str(tmp_path / "none"), batches=2) == 2
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
