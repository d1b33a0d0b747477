"""Vector files written by numpy and by the library, and parse audits."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from talentgrid.sources import audit, files
from talentgrid.sources.arrays import read_vectors, write_vectors


def rows_of(df):
    return {(r.file.rsplit("/", 1)[-1], r.row): r for r in df.collect()}


@pytest.mark.parametrize("dtype", ["<f4", "<f8", ">f8", "<f2", "<i4"])
def test_npy_is_split_into_row_ranges(spark, tmp_path, dtype):
    values = np.arange(1000 * 6).reshape(1000, 6).astype(dtype)
    np.save(tmp_path / "a.npy", values)
    df = read_vectors(spark, str(tmp_path / "a.npy"), rows=300)
    assert df.rdd.getNumPartitions() == 4
    got = rows_of(df)
    assert len(got) == 1000
    assert all(got["a.npy", i].vector == values[i].astype(float).tolist() for i in range(1000))


@pytest.mark.parametrize("save,parts", [(np.savez, 6), (np.savez_compressed, 2)])
def test_archives_with_keys(spark, tmp_path, save, parts):
    rng = np.random.default_rng(1)
    data = {}
    for name in ("x.npz", "y.npz"):
        ids, vec = np.array([f"{name}-{i}" for i in range(50)]), rng.normal(size=(50, 3))
        save(tmp_path / name, other=np.zeros(7), names=ids, vec=vec)
        data[name] = ids, vec
    (tmp_path / "notes.txt").write_text("not an array")
    df = read_vectors(spark, str(tmp_path), "vec", "names", rows=20)
    assert df.rdd.getNumPartitions() == parts
    got = rows_of(df)
    assert len(got) == 100
    for name, (ids, vec) in data.items():
        assert all(got[name, i].key == ids[i] and got[name, i].vector == vec[i].tolist() for i in range(50))


def test_damaged_and_foreign_arrays(spark, tmp_path):
    np.save(tmp_path / "objects.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="not an array of rows"):
        read_vectors(spark, str(tmp_path / "objects.npy")).count()
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.ones((4, 3))))
    with pytest.raises(Exception, match="not an array of rows"):
        read_vectors(spark, str(tmp_path / "columns.npy")).count()
    np.save(tmp_path / "short.npy", np.ones((40, 3)))
    whole = (tmp_path / "short.npy").read_bytes()
    (tmp_path / "short.npy").write_bytes(whole[:-8])
    with pytest.raises(Exception, match="ends within its rows"):
        read_vectors(spark, str(tmp_path / "short.npy")).collect()
    np.save(tmp_path / "empty.npy", np.ones((0, 3)))
    assert read_vectors(spark, str(tmp_path / "empty.npy")).count() == 0


def test_written_files_are_bounded_and_read_by_numpy(spark, tmp_path):
    df = spark.range(1000).select("id", F.array(F.col("id") * 1.0, F.col("id") * 2.0).alias("v")).repartition(3)
    path = str(tmp_path / "out")
    n = write_vectors(df, "id", "v", path, rows=100)
    names = sorted((tmp_path / "out").iterdir())
    assert n == len(names)
    sizes = []
    for name in names:
        with np.load(name) as z:
            sizes.append(len(z["ids"]))
            assert (z["vectors"] == z["ids"][:, None] * np.array([1.0, 2.0])).all()
    assert sum(sizes) == 1000 and max(sizes) <= 100
    back = read_vectors(spark, path, key="ids", rows=64)
    assert {(r.key, tuple(r.vector)) for r in back.collect()} == {(i, (i * 1.0, i * 2.0)) for i in range(1000)}
    with pytest.raises(Exception, match="must not be null"):
        write_vectors(df.withColumn("v", F.when(F.col("id") > 5, F.col("v"))), "id", "v", str(tmp_path / "bad"))


def test_parse_gates_count_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1, "y": "a"}\n{"x": "one", "y": "b"}\n{"x": 3, "y": \n\n{"x": null}\n')
    df = audit.read_audited(spark, str(tmp_path / "a.jsonl"), "json", "x long, y string")
    gates = {r.check: (r.passed, r.detail) for r in audit.parse_gates("a", df).collect()}
    assert gates == {"rows:a": (True, "4"), "rows_parse:a": (False, "2")}
    assert sorted(str(r.x) for r in audit.parsed(df).collect()) == ["1", "None"]
    (tmp_path / "none.jsonl").write_text("")
    none = audit.read_audited(spark, str(tmp_path / "none.jsonl"), "json", "x long, y string")
    gates = {r.check: r.passed for r in audit.parse_gates("n", none).collect()}
    assert gates == {"rows:n": False, "rows_parse:n": True}


def test_sources_report_dropped_records_of_the_reading_job(spark, tmp_path):
    (tmp_path / "p.csv").write_text('n,t\n1,"two\nlines, ""quoted"""\nx,bad\n3,c,surplus\n4,"d"\n'.replace('""', '\\"'))
    seen = Observation()
    got = files.postings_csv(spark, str(tmp_path / "p.csv"), "n double, t string", seen)
    assert sorted((r.n, r.t) for r in got.collect()) == [(1.0, 'two\nlines, "quoted"'), (4.0, "d")]
    assert seen.get == {"rows": 4, "unparsed": 2}
    good = '{"content": "python dev", "annotation": [{"label": ["Skills"], "points": [{"start": 0, "end": 5, "text": "python"}]}]}'
    (tmp_path / "d.jsonl").write_text(good + "\n{broken\n")
    seen = Observation()
    assert [(r.s, r.e) for r in files.annotated_documents(spark, str(tmp_path / "d.jsonl"), seen).collect()] == [(0, 6)]
    assert seen.get == {"rows": 2, "unparsed": 1}
