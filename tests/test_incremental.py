import pytest
from pyspark.sql import functions as F

from marlstone.operators.incremental import VersionedTable, instant, live_of_runs, record_delta, run_incrementally


def test_instant(spark):
    rows = ["2025-01-01T02:00:00.5+02:00", "2025-01-01T00:00:00.500000000Z", "2025-01-01T00:00:00.500000001Z", "", None, "soon", "2025-01-01 00:00:00", "2025-13-01T00:00:00Z"]
    got = [r.t for r in spark.createDataFrame([(r,) for r in rows], "x string").select(instant(F.col("x")).alias("t")).collect()]
    base = 1735689600 * 10**9
    assert got == [base + 5 * 10**8, base + 5 * 10**8, base + 5 * 10**8 + 1, None, None, None, base, None]


def test_ledger_delta(spark):
    runs = spark.createDataFrame([(1, "succeeded"), (2, "failed"), (3, None), (4, "succeeded")], "run_id int, status string")
    ledger = spark.createDataFrame([(1, "a", "1"), (1, "b", "1"), (4, "a", "2"), (4, "a", "2"), (2, "c", "1"), (3, "b", "9"), (1, None, "1")], "run_id int, k string, v string")
    now = spark.createDataFrame([("a", "2", 0), ("b", "9", 0), ("c", "1", 0), ("c", "1", 1), ("d", None, 0), (None, "1", 0)], "k string, v string, run_id int")
    live = live_of_runs(ledger, runs, ["k"], ["v"])
    got = record_delta(now, live, ["k"], ~F.col("now.v").eqNullSafe(F.col("live.v")))
    assert sorted(r.k for r in got.collect()) == ["b", "c", "d"]
    assert record_delta(now.limit(0), live, ["k"], F.lit(True)).count() == 0
    assert record_delta(now, live.limit(0), ["k"], F.lit(None).cast("boolean")).count() == 5


def test_versions_survive_failure(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    source, output = (VersionedTable(spark, str(tmp_path / n), ["k"]) for n in ("in", "out"))
    source.commit(rows(("a", 1), ("b", 1)))
    assert run_incrementally(source, output, "in", lambda df: df) == 1
    assert run_incrementally(source, output, "in", lambda df: df) is None
    source.commit(rows(("b", 2), ("c", 2)), rows(("a", 0)).select("k"))

    def crash(df):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        run_incrementally(source, output, "in", crash)
    assert output.version() == 1
    seen = []
    run_incrementally(source, output, "in", lambda df: seen.extend(r.k for r in df.collect()) or df)
    assert sorted(seen) == ["b", "c"]
    assert sorted(map(tuple, output.read().collect())) == sorted(map(tuple, source.read().collect())) == [("b", 2), ("c", 2)]
    upserted, deleted = source.delta(1)
    assert sorted(r.k for r in upserted.collect()) == ["b", "c"] and [r.k for r in deleted.collect()] == ["a"]
    assert sorted(map(tuple, source.read(1).collect())) == [("a", 1), ("b", 1)]
    with pytest.raises(FileExistsError):  # a slow run that worked from version 1 may not commit after version 2
        output.commit(rows(("b", 1)), base=1)
    before = source.version()
    assert source.compact() == before + 1 and len(source.manifest()["files"]) == 1
    assert sorted(map(tuple, source.read().collect())) == [("b", 2), ("c", 2)]
    upserted, deleted = source.delta(before)  # the same records in another file
    assert upserted.count() == 0 and deleted.count() == 0
    source.commit(rows((None, 5), ("c", 3)))
    source.commit(rows((None, 6)))
    assert sorted(map(tuple, source.read().collect()), key=str) == [("b", 2), ("c", 3), (None, 6)]
    upserted, deleted = source.delta(before)
    assert sorted(map(tuple, upserted.collect()), key=str) == [("c", 3), (None, 6)] and deleted.count() == 0


def test_runs_as_versions(spark, tmp_path):
    runs = spark.createDataFrame([(1, "succeeded"), (2, "failed"), (3, None), (4, "succeeded"), (5, "succeeded")], "run_id bigint, status string")
    ledger = spark.createDataFrame([(1, "a", "1"), (1, "b", "1"), (4, "a", "2"), (4, "a", "2"), (2, "c", "1"), (3, "b", "9"), (1, None, "1"), (5, "e", "1")], "run_id bigint, k string, v string")
    table = VersionedTable(spark, str(tmp_path / "runs"), ["k"])
    done = table.take_runs(ledger, runs, ["v"])
    assert done == 3 and table.manifest()["processed"] == {"run": 5}
    assert sorted(map(tuple, table.read(1).collect()), key=str) == [("a", "1"), ("b", "1"), (None, "1")]
    live = sorted(map(tuple, table.read().collect()), key=str)
    assert live == sorted(map(tuple, live_of_runs(ledger, runs, ["k"], ["v"]).collect()), key=str)
    upserted, deleted = table.delta(1, 2)
    assert [tuple(r) for r in upserted.collect()] == [("a", "2")] and deleted.count() == 0
    now = spark.createDataFrame([("a", "2", 0), ("b", "9", 0), ("c", "1", 0), ("c", "1", 1), ("d", None, 0), (None, "1", 0)], "k string, v string, run_id int")
    now.write.parquet(str(tmp_path / "now"))
    upserted, deleted = table.delta(done, table.adopt(str(tmp_path / "now"), ["k", "v"]))
    assert sorted({r.k for r in upserted.collect()}) == ["b", "c", "d"] and [r.k for r in deleted.collect()] == ["e"]
    none = VersionedTable(spark, str(tmp_path / "none"), ["k"])
    assert none.take_runs(ledger.limit(0), runs, ["v"]) == 0 and none.read() is None
    assert none.delta(0, none.adopt(str(tmp_path / "now"), ["k", "v"]))[0].count() == 6
