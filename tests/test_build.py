"""From a tree, an archive or a store to a graph, and comparisons as data."""

import json
import zipfile

from graphloom import build
from graphloom.operators import compare
from graphloom.sinks import export
from graphloom.sources.incremental import FactStore
from graphs import server

TREE = {"a/one.py": "import os\nclass A:\n    def go(self):\n        self.stop()\n    def stop(self):\n        pass\n", "a/skip.py": "x = 1\n", ".gitignore": "skip.py\n", "b.md": "words\n", "my_token.py": "def t():\n    pass\n"}


def test_tree_archive_and_store_give_one_graph(spark, tmp_path):
    root = tmp_path / "src"
    for k, v in TREE.items():
        (root / k).parent.mkdir(parents=True, exist_ok=True)
        (root / k).write_text(v)
    with zipfile.ZipFile(tmp_path / "src.zip", "w") as z:
        for k, v in TREE.items():
            z.writestr(f"src/{k}", v)
    store = FactStore(spark, f"file://{tmp_path}/facts", parts=2)
    found = [build.build(spark, str(root)), build.build(spark, str(tmp_path / "src.zip")), build.build(spark, str(root), store)]
    labels = [sorted(r["label"] for r in b.graph.nodes.collect()) for b in found]
    assert labels[0] == [".go()", ".stop()", "A", "one.py"] and labels[1] == labels[0] == labels[2]
    edges = [sorted((r["source"], r["relation"], r["target"]) for r in b.graph.edges.collect()) for b in found]
    assert ("a_one_a_go", "calls", "a_one_a_stop") in edges[0] and edges[1] == edges[0] == edges[2]
    assert {r["path"]: r["skipped"] for r in found[0].files.collect()} == {"a/one.py": False, "b.md": False, "my_token.py": True}
    assert {(r["kind"], r["message"]) for r in found[0].faults.collect()} == {("dangling_target", "os")} and found[2].version == 1
    (root / "a/one.py").write_text(TREE["a/one.py"] + "def more():\n    pass\n")
    assert build.build(spark, str(root), store).version == 2
    old, new = (build.graph_of(*store.graph(v)[:2]).nodes.count() for v in (1, 2))
    assert (old, new) == (4, 5)


def test_comparison_as_rows_and_report(spark, tmp_path):
    a = server(spark)
    b = type(a)(a.nodes.filter("id != 'go_pkg_fmt'"), a.edges.filter("target != 'go_pkg_fmt'"))
    scores = compare.graph_scores(a, b)
    sections = {"scores": scores, "nodes": compare.diff.diff_nodes(a, b), "edges": compare.diff.diff_edges(a, b)}
    sections["distance"] = compare.diff.approximate_edit_distance(sections["nodes"], sections["edges"])
    sections["composite"] = compare.composite(scores, compare.weights_table(spark, {"NodeJaccard": 1.0}))
    assert sections["composite"].first()["composite"] == 8 / 9
    none = scores.selectExpr("metric", "IF(metric = 'NodeJaccard', NULL, score) AS score")
    assert compare.composite(none, compare.weights_table(spark, {"NodeJaccard": 1.0, "EdgeJaccard": 1.0})).first()["composite"] is None
    row = build.sizes(a, b, sections).first()
    assert (row["nodes_a"], row["nodes_b"], row["nodes_removed"], row["nodes_added"], row["edges_removed"]) == (9, 8, 1, 0, 2)
    export.write_comparison(sections, f"{tmp_path}/c")
    read = spark.read.text(f"{tmp_path}/c").collect()
    gone = [json.loads(r["value"]) for r in read if r["section"] == "nodes"]
    assert {x["id"] for x in gone if x["status"] == "removed"} == {"go_pkg_fmt"} and all("changes" in x for x in gone)
