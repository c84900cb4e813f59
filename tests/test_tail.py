"""The log source: file order, restarts, incomplete lines, pieces of any size, undated lines."""

import pytest

from clusterlens.sources import logs, tail
from clusterlens.streaming import queries

C2 = "container_15_0001_01_000002"


def write(path, text, mode="wb"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode) as f:
        f.write(text.encode() if isinstance(text, str) else text)


def run(spark, df, tmp_path, name):
    query = queries.start(df, queries.append_table(str(tmp_path / name)), name, str(tmp_path / "progress"), trigger=None)
    assert query.awaitTermination(120)


def read(spark, tmp_path, name):
    rows = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / name)).collect()
    return [r.line for r in sorted(rows, key=lambda r: r.seq)], [r.seq for r in sorted(rows, key=lambda r: r.seq)]


def test_restart_reads_on_without_loss(spark, tmp_path):
    log = tmp_path / "in" / "app" / C2 / "stderr"
    write(log, "one\ntwo\nhal")

    def stream(**more):
        return logs.read_container_logs(spark, str(tmp_path / "in"), streaming=True, **more)

    run(spark, stream(), tmp_path, "all")
    assert read(spark, tmp_path, "all") == (["one", "two"], [0, 4])
    run(spark, stream(from_end=True), tmp_path, "new")
    write(log, "f\n\nthré\r\n", "ab")
    write(tmp_path / "in" / "app" / C2 / "stdout", "x\n")
    run(spark, stream(), tmp_path, "all")
    run(spark, stream(from_end=True), tmp_path, "new")
    lines, seq = read(spark, tmp_path, "all")
    assert sorted(lines) == sorted(["one", "two", "half", "", "thré", "x"])
    assert sorted(read(spark, tmp_path, "new")[0]) == sorted(["half", "", "thré", "x"])
    kept = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "all")).where("path like '%stderr'").orderBy("seq")
    assert [r.line for r in kept.collect()] == ["one", "two", "half", "", "thré"]


@pytest.mark.parametrize("size", [1, 3, 10, 64, 1 << 20])
def test_pieces_hold_every_line_once(tmp_path, size):
    text = "\n".join(["2020-01-01 00:00:01 a", "\tat x", "", "y" * 200_000, "17/07/25 23:57:16 b", "zz"] * 2) + "\n"
    path = tmp_path / "log"
    write(path, text + "open end")
    files = tail.Files({"path": str(path), "bytespertask": str(max(size, len(text) // 400 if size < 64 else 1))})
    ends = files.ends()
    assert list(ends.values()) == [len(text)]
    rows = [r for p in files.pieces({}, ends) for b in files.read(p) for r in b.to_pylist()]
    assert [r["line"] for r in rows] == text.split("\n")[:-1]
    assert all(text[r["seq"] :].startswith(r["line"] + "\n") for r in rows)
    first = "2020-01-01 00:00:01"
    assert [r["dated"] for r in rows] == ([first] * 4 + ["17/07/25 23:57:16"] * 2) * 2
    path.write_text("new\n")
    assert [(p.begin, p.end) for p in tail.Files({"path": str(path)}).pieces(ends, {str(path): 4})] == [(0, 4)]


def test_since_keeps_undated_lines_with_their_dated_one(spark, tmp_path):
    text = "no time\n2020-01-01 00:00:00,1 early\n\tat early\n2020-01-03 00:00:00,1 late\n\tat late\n\tat late 2\n"
    write(tmp_path / "nm" / "a.log", text)
    want = ["2020-01-03 00:00:00,1 late", "\tat late", "\tat late 2"]
    for more in ({}, {"bytesPerTask": 10}):
        out = logs.read_daemon_log(spark, str(tmp_path / "nm"), "nm", since="2020-01-02", **more)
        assert [r.line for r in sorted(out.collect(), key=lambda r: r.seq)] == want
    run(spark, logs.read_daemon_log(spark, str(tmp_path / "nm"), "nm", since="2020-01-02", streaming=True), tmp_path, "nm-out")
    assert read(spark, tmp_path, "nm-out")[0] == want
    write(tmp_path / "gbk" / "b.log", "2020-01-03 00:00:00 第\n行\n".encode("gbk"))
    out = logs.read_daemon_log(spark, str(tmp_path / "gbk"), "nm", since="2020-01-02", encoding="gbk")
    assert sorted(r.line for r in out.collect()) == ["2020-01-03 00:00:00 第", "行"]
