import struct

import pytest

from boxwood import pack
from boxwood.cli import main, parse
from boxwood.sources import meshes
from boxwood.streaming.rebuild import rebuild_on_batch


def test_options():
    assert parse(["-n", "2", "a.obj", "-o", "--what"]) == ({"-o"}, {"-n": "2"}, ["a.obj"], ["--what"])
    assert parse(["--to", "a.obj", "b.obj"]) == ({"--to"}, {}, ["a.obj", "b.obj"], [])
    for wrong in (["-m", "0"], ["-n", "x"], ["-n"]):
        with pytest.raises(SystemExit):
            parse(wrong)


def test_main(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    text = "v 0 0 0\nv 1 0 0\nv 0 1 1\nv 9 9 9\nv 8 9 9\nv 9 8 8\nf 1 2 3\nf 4 5 6\n"
    (tmp_path / "a.obj").write_text(text)
    assert main(["-o", "--csv", "-m", "3", "--to", str(tmp_path / "a.obj")]) == 0
    out = capsys.readouterr()
    assert out.out.split() == ["0", "1"] and (tmp_path / "a.obj").read_text() == text
    assert (tmp_path / "kdtree.binary").read_bytes()[:4] == struct.pack("<I", 2)
    assert main(["--csv-header", "-m", "3"]) == 0
    names = capsys.readouterr().err.strip().split(",")
    row = next(x for x in out.err.splitlines() if x.count(",") == len(names) - 1).split(",")
    assert names[:2] == ["Threads", "Start time"] and row[0] == "1" and all(a <= b for a, b in zip(row[1:4], row[2:5]))
    assert dict(zip(names, row))["finish_start"] != "" and "findBestPlane_2_end" in names
    assert main([]) == 1


def test_packer(spark, tmp_path, capsysbinary):
    obj = tmp_path / "a.obj"
    obj.write_text("v 0 0 0\nv 1 0 0\nv 0 1 1\nv 9 9 9\nf 1 2 3\nf 4 2 3\n")
    assert pack.main([str(obj)]) == 0
    (tmp_path / "a.blob").write_bytes(capsysbinary.readouterr().out)
    got = [tuple(r) for r in meshes.read_blob(spark, str(tmp_path / "a.blob")).orderBy("tri").collect()]
    assert got == [(0, 0, 1, 0, 1, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1, 1), (1, 0, 9, 0, 9, 0, 9, 9, 9, 9, 1, 0, 0, 0, 1, 1)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        pack.main([str(tmp_path / "none.obj")])


def test_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = spark.range(10).selectExpr("id AS tri", *(f"float(id + {k}) AS {c}{k}" for c in "xyz" for k in (0, 1)))
    rows.write.parquet(src)
    seen = {}
    query = rebuild_on_batch(spark.readStream.schema(rows.schema).parquet(src), str(tmp_path / "boxes"), str(tmp_path / "ck"), lambda tree, n: seen.update({n: tree.leaves.select("tri").distinct().count()}))
    query.awaitTermination(120)
    assert seen == {0: 10}
