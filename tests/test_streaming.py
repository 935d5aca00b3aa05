import json

from marlstone.operators.incremental import VersionedTable
from marlstone.streaming import spans as st


def span(i, trace, session=None, name="x", start=10**18, status=""):
    return {"trace_id": trace, "span_id": f"s{i}", "parent_span_id": None, "name": name, "start_time_unix_nano": start + i, "end_time_unix_nano": start + i + 5, "attributes": {}, "status": status, "session_id": session}


def write(folder, batches):
    folder.mkdir()
    for n, batch in enumerate(batches):
        lines = [json.dumps(r) if isinstance(r, dict) else r for r in batch]
        (folder / f"{n}.json").write_text("\n".join(lines) + "\n")


def collected(spark, df, name, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_late_sessions(spark, tmp_path):
    write(tmp_path / "in", [[span(1, "t1"), span(2, "t2", "sb"), "not json"], [span(3, "t1", "sa"), span(4, "t2")], [span(5, "t1"), span(6, "t3")]])
    out = collected(spark, st.with_late_sessions(st.read_spans(spark, str(tmp_path / "in"))), "late", tmp_path)
    assert {r.span_id: r.session for r in out} == {"s1": "sa", "s2": "sb", "s3": "sa", "s4": "sb", "s5": "sa"}


def test_each_span_once_and_windows(spark, tmp_path):
    write(tmp_path / "in", [[span(1, "t", "s"), span(1, "t", "s"), span(2, "t", "s", status="error")], [span(1, "t", "s")]])
    assert sorted(r.span_id for r in collected(spark, st.once(st.read_spans(spark, str(tmp_path / "in"))), "once", tmp_path)) == ["s1", "s2"]
    out = collected(spark, st.windowed(st.read_spans(spark, str(tmp_path / "in"))), "windows", tmp_path, "complete")
    assert [(r.spans, r.errors) for r in out] == [(4, 1)]


def test_sessions_are_kept(spark, tmp_path):
    write(tmp_path / "in", [[span(1, "t", "s"), span(2, "u", "v")], [span(3, "t", "s", status="error"), span(1, "t", "s")]])
    table = VersionedTable(spark, str(tmp_path / "table"), ["session"])
    st.keep_sessions(st.read_spans(spark, str(tmp_path / "in")), table, str(tmp_path / "check")).awaitTermination(120)
    assert {(r.session, r.spans, r.errors) for r in table.read().collect()} == {("s", 2, 1), ("v", 1, 0)}
    version = table.version()
    st.keep_sessions(st.read_spans(spark, str(tmp_path / "in")), table, str(tmp_path / "check")).awaitTermination(120)
    assert table.version() == version == 2
