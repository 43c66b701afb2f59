"""Data sources: one vector file of many tasks' parts, a file a note, archives read in ranges of members."""

import io
import os
import tarfile
import zipfile

import pytest

from graphloom.sinks import export, writers
from graphloom.sources import archives, detect, files
from graphs import communities, server


def test_vector_file_round_trip(spark, tmp_path):
    rows = [(f"n{i:04d}é", [float(i), 0.5, -1.0]) for i in range(500)] + [("z", [1.0]), (None, [1.0, 2.0, 3.0]), ("y", None), ("n0007é", [7.0, 0.5, -1.0])]
    path = f"{tmp_path}/v.bin"
    assert writers.write_vectors(spark.createDataFrame(rows, "id string, vec array<double>").repartition(7), path, "model ü") == 3
    found = files.parse_vectors(open(path, "rb").read())
    assert found == [("model ü", i, v) for i, v in sorted(rows[:500])]
    assert {r["id"] for r in files.load_vectors(spark, path).collect()} == {r[0] for r in rows[:500]}
    writers.write_vectors(spark.createDataFrame(rows[:2], "id string, vec array<float>"), path)  # replaced as a whole
    assert len(files.parse_vectors(open(path, "rb").read())) == 2
    assert writers.write_vectors(spark.createDataFrame([], "id string, vec array<float>"), f"{tmp_path}/none.bin") == 0
    assert files.parse_vectors(open(f"{tmp_path}/none.bin", "rb").read()) == []
    assert [n for n in os.listdir(tmp_path) if ".run-" in n] == []


def test_failed_write_leaves_the_target(spark, tmp_path):
    path = f"{tmp_path}/v.bin"
    writers.write_vectors(spark.createDataFrame([("a", [1.0])], "id string, vec array<float>"), path)
    bad = spark.range(4).selectExpr("CAST(id AS STRING) AS id", "array(IF(id = 3, CAST(raise_error('stop') AS FLOAT), 1f)) AS vec")
    with pytest.raises(Exception, match="stop"):
        writers.write_vectors(bad, path, dim=1)
    assert files.parse_vectors(open(path, "rb").read()) == [("", "a", [1.0])] and os.listdir(tmp_path) == ["v.bin"]


def test_notes_round_trip(spark, tmp_path):
    notes = export.obsidian(server(spark), communities(spark))
    writers.write_notes(notes.repartition(3), f"{tmp_path}/vault")
    assert sorted(map(tuple, writers.read_notes(spark, f"{tmp_path}/vault").collect())) == sorted(map(tuple, notes.collect()))
    odd = spark.createDataFrame([("a b+c%é", "x"), ("none", None)], "name string, value string")
    writers.write_notes(odd, f"{tmp_path}/vault")
    assert sorted(map(tuple, writers.read_notes(spark, f"{tmp_path}/vault").collect())) == [("a b+c%é", "x"), ("none", "")]
    assert os.listdir(tmp_path) == ["vault"]


def test_archives_are_read_in_ranges(spark, tmp_path):
    members = {f"top/d{i % 5}/f{i}.py": f"x = {i}\n".encode() * 50 for i in range(60)} | {"top/b.bin": b"\xff\xfe", "top/.gitignore": b"d1/\n", "top/empty.py": b""}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("top/folder")
        for n, data in members.items():
            z.writestr(n, data)
    for name, mode in (("a.tar", "w"), ("a.tgz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as t:
            for n, data in members.items():
                info = tarfile.TarInfo(n)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
            link = tarfile.TarInfo("top/link")
            link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
            t.addfile(link)
    for name, parts in (("a.zip", 5), ("a.tar", 5), ("a.tgz", 1)):
        found = archives.read_archive(spark, f"{tmp_path}/{name}", 4000)
        assert found.rdd.getNumPartitions() >= parts if parts > 1 else found.rdd.getNumPartitions() == 1
        assert {r["path"]: bytes(r["content"]) for r in found.collect()} == {n[4:]: d for n, d in members.items()}
        assert found.filter("path = 'b.bin'").first()["text"] is None
        assert {r["path"] for r in detect.detect(found).collect()} == {n[4:] for n in members if n.endswith(".py") and "/d1/" not in n}


def test_entries_that_leave_the_archive_are_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as z:
        z.writestr("../out.py", "x")
    with pytest.raises(Exception, match="leaves the archive"):
        archives.read_archive(spark, f"{tmp_path}/evil.zip").collect()
