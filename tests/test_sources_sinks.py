import io
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.sinks import export
from graphloom.sources import detect, extract, files
from graphloom.streaming import watch
from graphs import communities, server

PY = '''import os
from .base import Thing

class Server(Base):
    # starts it
    def start(self):
        log.info("x")
        self.check()
        helper(3)

    async def check(self):
        raise ValueError("bad")

def helper(x):
    return open(x)
'''
SAMPLES = {
    "main.go": ('package main\nimport "fmt"\ntype Server struct {\n}\nfunc NewServer() *Server {\n\treturn nil\n}\nfunc (s *Server) Start() {\n\tHelper()\n}\nfunc Helper() {\n\tfmt.Println(1)\n}\n', {"Server", "NewServer()", ".Start()", "Helper()"}, {"contains", "method", "imports_from", "calls"}),
    "a.rs": ("use std::fs;\nstruct Point {\n}\nimpl Point {\n    pub fn new() -> Point {\n        helper()\n    }\n}\nfn helper() {\n}\n", {"Point", ".new()", "helper()"}, {"contains", "method", "imports_from", "calls"}),
    "A.java": ("import java.util.List;\npublic class A extends B {\n    public void run() {\n        help();\n    }\n    private int help() {\n        return 1;\n    }\n}\n", {"A", ".run()", ".help()"}, {"contains", "method", "imports", "extends", "calls"}),
    "a.rb": ("class A\n  def go\n    help\n  end\nend\n", {"A", ".go()"}, {"contains", "method"}),
    "a.swift": ("import Foundation\nclass A: B {\n    func go() {\n    }\n}\n", {"A", ".go()"}, {"contains", "method", "imports", "inherits"}),
    "a.ex": ("defmodule A do\n  alias B.C\n  def go(x) do\n    x\n  end\nend\n", {"A", ".go()"}, {"contains", "method", "imports"}),
    "a.jl": ("using Base64\nstruct P\nend\nfunction go(x)\n    x\nend\n", {"P", "go()"}, {"contains", "imports"}),
    "a.c": ('#include "x.h"\nint add(int a, int b) {\n    return a;\n}\n', {"add()"}, {"contains", "imports"}),
    "a.dart": ("import 'x.dart';\nclass A {\n  void go() {\n  }\n}\n", {"A", ".go()"}, {"contains", "method", "imports"}),
    "p.blade.php": ('@include("layout.head")\n<livewire:counter />\n<button wire:click="save">\n', set(), {"includes", "uses_component", "binds_method"}),
    "a.lua": ("local x = require('mod')\nfunction go()\nend\n", {"go()"}, {"contains", "imports"}),
    "a.zig": ('const std = @import("std");\nconst P = struct {\n};\npub fn go() void {\n}\n', {"P", "go()"}, {"contains", "imports"}),
    "a.v": ("module top(input a);\n  adder u1 (\n  );\nendmodule\n", {"top"}, {"contains", "instantiates"}),
    "a.ps1": ("function Get-It {\n}\n", {"Get-It()"}, {"contains"}),
    "a.kt": ("import a.b.C\nclass A {\n    fun go() {\n    }\n}\n", {"A", ".go()"}, {"contains", "method", "imports"}),
    "a.scala": ("import a.b.C\nobject A {\n  def go = 1\n}\n", {"A", ".go()"}, {"contains", "method", "imports"}),
    "a.php": ("<?php\nuse A\\B;\nclass C {\n    public function go() {\n    }\n}\n", {"C", ".go()"}, {"contains", "method", "imports"}),
    "a.cs": ("using System;\nnamespace N\n{\n    class A : B\n    {\n        public void Go()\n        {\n        }\n    }\n}\n", {"A", ".Go()"}, {"contains", "method", "imports", "inherits"}),
    "a.m": ("#import <F/F.h>\n@interface A : NSObject\n- (void)go;\n@end\n", {"A"}, {"contains", "imports", "inherits"}),
    "a.cpp": ("#include <x>\nclass A {\n  void go() {\n  }\n};\n", {"A", ".go()"}, {"contains", "method", "imports"}),
    "a.ts": ("import {x} from './u';\nexport class A {\n  run() {\n  }\n}\nexport const f = (a) => a\n", {"A", ".run()", "f()"}, {"contains", "method", "imports_from"}),
}


def test_python_extraction(spark):
    nodes, edges, calls = extract.extract(spark.createDataFrame([("app/server.py", PY), ("x.unknown", "?"), ("none.py", None)], "path string, text string"))
    rows = {r["id"]: r for r in nodes.collect()}
    assert rows["app_server_server_start"]["label"] == ".start()" and rows["app_server_server_start"]["comment"] == "starts it"
    assert rows["app_server_server_start"]["tags"] == ["comment", "logs"] and rows["app_server_server_check"]["tags"] == ["async", "throws"] and rows["app_server_helper"]["tags"] == ["fs"]
    found = {(r["source"], r["relation"], r["target"]) for r in edges.collect()}
    assert {
        ("app_server_py", "contains", "app_server_server"), ("app_server_server", "method", "app_server_server_start"), ("app_server_server_start", "calls", "app_server_helper"),
        ("app_server_server_start", "calls", "app_server_server_check"), ("app_server_py", "imports", "os"), ("app_server_py", "imports_from", "base"), ("app_server_server", "inherits", "app_server_base"),
    } <= found
    assert "ValueError" in {r["callee"] for r in calls.collect()}


def test_languages(spark):
    nodes, edges, _ = extract.extract(spark.createDataFrame([(k, v[0]) for k, v in SAMPLES.items()], "path string, text string"))
    labels, relations = {}, {}
    for r in nodes.collect():
        labels.setdefault(r["source_file"], set()).add(r["label"])
    for r in edges.filter("confidence = 'EXTRACTED'").collect():
        relations.setdefault(r["source_file"], set()).add(r["relation"])
    for path, (_, wanted, kinds) in SAMPLES.items():
        assert wanted <= labels[path], (path, labels[path])
        assert kinds <= relations.get(path, set()), (path, relations.get(path))


def test_calls_across_files(spark):
    two = [("a.py", "def caller():\n    target()\n"), ("b.py", "def target():\n    pass\n")]
    _, edges, _ = extract.extract(spark.createDataFrame(two, "path string, text string"))
    r = edges.filter("relation = 'calls'").first()
    assert (r["source"], r["target"], r["confidence"], r["confidence_score"]) == ("a_caller", "b_target", "INFERRED", 0.8)


def test_detection(spark, tmp_path):
    for name, text in {
        "a.py": "x = 1 2", "doc.md": "three words here", "paper.txt": "Abstract arXiv doi: journal [1]", "node_modules/x.js": "x", ".hidden": "h",
        "my_token.py": "t", "go.sum": "s", "pic.png": "p", "x.bin": "b", "gen/out.py": "g", "gen/keep.py": "k", "Dockerfile": "d", "i.xcassets/a.pdf": "p", "b.pdf": "p",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    rules = detect.parse_ignore("", "# none\ngen/*.py\n") + detect.parse_ignore("", "!gen/keep.py", True, 10)
    found = detect.detect(detect.read_tree(spark, str(tmp_path)), rules)
    rows = {r["path"]: (r["file_type"], r["words"], r["skipped"]) for r in found.collect()}
    assert rows == {
        "a.py": ("code", 4, False), "doc.md": ("document", 3, False), "paper.txt": ("paper", 5, False), "my_token.py": ("code", 0, True), "pic.png": ("image", 1, False), "gen/keep.py": ("code", 1, False), "b.pdf": ("paper", 1, False),
    }
    assert detect.summary(found).first()["warning"] == "small"
    listed = spark.createDataFrame([("sub/.git", "gitdir: ../x"), ("sub/y.py", "y"), ("z.py", "z"), (".env", "k")], "path string, text string")
    assert {r["path"]: r["skipped"] for r in detect.detect(listed).collect()} == {"z.py": False, ".env": True}
    tree = detect.read_tree(spark, str(tmp_path)).filter("path = 'a.py'")
    cache = tree.select(detect.content_hash(F.col("path"), F.col("text")).alias("hash"))
    assert detect.not_cached(tree, cache).count() == 0 and detect.not_cached(tree, cache.limit(0)).count() == 1


def test_ignore_files_and_names_that_begin_with_an_underscore(spark, tmp_path):
    for name, text in {
        "pkg/__init__.py": "x", "pkg/_own.py": "y", "pkg/deep/a.py": "z", "pkg/deep/b.py": "z", "gen/x.py": "g", "log.md": "l", "pkg/log.md": "l", ".gitignore": "gen/\n/log.md\n!gen/x.py\n",
        "pkg/deep/.gitignore": "*.py\n", "pkg/deep/.graphloomignore": "!b.py\n", ".git/config": "c", "node_modules/m/i.js": "n",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    tree = detect.read_tree(spark, f"file://{tmp_path}")
    assert {r["path"] for r in detect.detect(tree).collect()} == {"pkg/__init__.py", "pkg/_own.py", "pkg/deep/b.py", "pkg/log.md"}
    assert {r["path"] for r in detect.list_tree(spark, str(tmp_path)).collect()} >= {".gitignore", "pkg/__init__.py"}


def test_node_link_repeats_and_unknown_endpoints(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes":[{"id":"a","label":"old","file_type":"code"},{"id":"a","label":"new"}],"links":[{"source":"a","target":"b","relation":"calls"},{"source":"b","target":"a","relation":"uses"}]}')
    g = files.load_node_link(spark, str(tmp_path / "g.json"))
    assert {r["id"]: (r["label"], r["file_type"]) for r in g.nodes.collect()} == {"a": ("new", "code"), "b": (None, None)}
    assert [r["relation"] for r in g.edges.collect()] == ["uses"]


def test_node_link_round_trip(spark, tmp_path):
    g = server(spark)
    export.write_node_link(g, str(tmp_path / "g"))
    back = files.load_node_link_folders(spark, str(tmp_path / "g"))
    assert back.counts().first() == g.counts().first()
    rows = export.node_link_json(g).collect()
    document = '{"directed":false,"graph":{},"nodes":[%s],"links":[%s]}' % tuple(",".join(r["value"] for r in rows if r["part"] == p) for p in ("nodes", "links"))
    (tmp_path / "one.json").write_text(document)
    one = files.load_node_link(spark, str(tmp_path / "one.json"))
    assert one.counts().first() == g.counts().first() and one.nodes.filter("id = 'main_main'").first()["tags"] == ["throws"]


def test_vector_files(spark, tmp_path):
    body = struct.pack("<3I", 1, 2, 1) + b"m" + struct.pack("<I", 2) + b"".join(struct.pack("<I", len(i)) + i + struct.pack("<2f", *v) for i, v in ((b"a", (1, 2)), (b"bb", (3, 4))))
    (tmp_path / "v.bin").write_bytes(b"GFYE" + body)
    assert [(r["model"], r["id"], r["vec"]) for r in files.load_vectors(spark, str(tmp_path / "v.bin")).orderBy("id").collect()] == [("m", "a", [1.0, 2.0]), ("m", "bb", [3.0, 4.0])]
    with pytest.raises(ValueError):
        files.parse_vectors(b"nope" + body)


def test_office_and_archives(spark, tmp_path):
    w = "xmlns:w='http://w'"
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:document>")
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>h1</t></si><si><t>h2</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData><row><c t='s'><v>0</v></c><c t='s'><v>1</v></c></row><row><c><v>7</v></c></row></sheetData></worksheet>")
    rows = spark.createDataFrame([("a.docx", doc.getvalue(), None), ("b.xlsx", sheet.getvalue(), None), ("c.docx", b"broken", None), ("d.txt", b"x", "x")], "path string, content binary, text string")
    text = {r["path"]: r["text"] for r in files.readable(rows).collect()}
    assert text == {"a.docx": "# Title\nBody", "b.xlsx": "## sheet1\n| h1 | h2 |\n| --- | --- |\n| 7 |  |", "c.docx": None, "d.txt": "x"}
    tar = tmp_path / "s.tgz"
    with tarfile.open(tar, "w:gz") as t:
        info = tarfile.TarInfo("top/a.py")
        info.size = 1
        t.addfile(info, io.BytesIO(b"x"))
    assert files.unpack_archive(str(tar), str(tmp_path / "cache")).endswith("/top")
    bad = tmp_path / "bad.zip"
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(ValueError):
        files.unpack_archive(str(bad), str(tmp_path / "cache"))
    assert files.is_archive("x.tar.gz") and not files.is_archive("x.gz") and files.is_git_url("git@host:a/b.git") and not files.is_git_url("/tmp/x") and files.is_hex_hash("abcdef1")
    models = spark.createDataFrame([("llama:70b",), ("qwen:8b",), ("tiny:1b",)], "name string")
    assert files.pick_model(models, []).first()["name"] == "qwen:8b" and files.pick_model(models, ["llama"]).first()["name"] == "llama:70b"


def test_exports(spark):
    g, c = server(spark), communities(spark)
    xml = [r["value"] for r in export.graphml(g, c).collect()]
    assert xml[0].startswith("<?xml") and xml[-1] == "</graphml>" and sum(x.startswith("<node ") for x in xml) == 9 and sum(x.startswith("<edge ") for x in xml) == 11
    statements = [r["value"] for r in export.cypher(g).collect()]
    assert len(statements) == 20 and "MERGE (a)-[:CALLS {confidence: 'EXTRACTED'}]->(b);" in statements[-1] + "".join(statements)
    chart = export.mermaid(g, c)
    assert chart.startswith("flowchart TD") and "n_main_main --> n_main_server" in chart and ":::throws" in chart and "classDef throws" in chart and "n_go_pkg_fmt" not in chart
    notes = {r["name"]: r["value"] for r in export.obsidian(g, c).collect()}
    assert len(notes) == 11 and "[[Server]]" in notes["main.go"] and "tightly connected" in notes["_community_1"]
    vis, edges, legend = export.view_rows(g, c)
    assert vis.filter("id = 'main_server'").first()["size"] == 40 and edges.filter("dashes").count() == 2 and legend.count() == 2
    text = export.report(g, c)
    assert "9 nodes, 11 edges" in text and "1. Server - 4 edges" in text


def test_debounce_and_listing_difference(spark):
    rows = [("u", f"2024-01-01 00:00:0{s}") for s in (0, 1, 3, 8)]
    found = watch.debounce(spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("ts")), "3 seconds", "k")
    assert sorted(r["events"] for r in found.collect()) == [1, 3]
    listing = lambda *x: spark.createDataFrame(x, "path string, modificationTime long, length long")
    change = watch.changed_files(listing(("a", 1, 1), ("b", 1, 1), ("c", 1, 1)), listing(("a", 1, 1), ("b", 2, 1), ("d", 1, 1)))
    assert {r["path"]: r["change"] for r in change.collect()} == {"b": "modified", "c": "removed", "d": "added"}


def test_watching_rebuilds(spark, tmp_path):
    (tmp_path / "src").mkdir()
    out = str(tmp_path / "out")

    def rebuild(batch, version):
        named = batch.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("content").cast("string").alias("text"))
        nodes, edges, _ = extract.extract(named)
        watch.publish({"nodes": nodes.drop("ord"), "edges": edges.drop("ord")}, out, version)

    for i, name in enumerate(("a.py", "b.py")):
        (tmp_path / "src" / name).write_text(f"def f{i}():\n    pass\n")
        watch.watch(spark, str(tmp_path / "src"), rebuild, str(tmp_path / "check"), "*.py", None).awaitTermination(60)
        assert f"f{i}()" in {r["label"] for r in watch.latest(spark, out, "nodes").collect()}
