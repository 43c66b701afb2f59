"""Ignore rules as a table, incremental extraction, and rebuilds after changes have settled."""

import datetime

from graphloom.sources import detect, extract, incremental
from graphloom.streaming import watch


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def rows_of(graph):
    return [sorted(map(str, df.collect())) for df in graph]


TREE = {
    "a/one.py": "import a.two as t\nclass A:\n    def go(self):\n        t.help()\n        self.stop()\n    def stop(self):\n        late()\n",
    "a/two.py": "def help():\n    pass\n",
    "b/three.js": "import { late } from './four';\nfunction run() { late(); }\n",
    "b/four.js": "export function late() { return 1 }\n",
    "c/K.java": "class K extends Base { void m() { throw new X(\"no\"); } }\n",
}


def test_second_run_extracts_changed_files_only(spark, tmp_path, monkeypatch):
    store = incremental.FactStore(spark, f"file://{tmp_path}/facts", parts=4)
    assert rows_of(store.graph()) == [[], [], []] and store.versions() == []
    asked = []
    whole = extract.facts

    def counted(files):
        asked.append({r["path"] for r in files.select("path").collect()})
        return whole(files)

    monkeypatch.setattr(incremental, "facts", counted)
    first, _ = store.update(table(spark, list(TREE.items())))
    later = {k: v for k, v in TREE.items() if k != "b/four.js"} | {"a/two.py": "def help():\n    more()\n", "d/new.py": "def more():\n    pass\n"}
    second, changed = store.update(table(spark, list(later.items())))
    assert {(r["path"], r["change"]) for r in changed.collect()} == {("b/four.js", "removed"), ("a/two.py", "modified"), ("d/new.py", "added")}
    assert asked == [set(TREE), {"a/two.py", "d/new.py"}]
    assert rows_of(store.graph(second)) == rows_of(extract.extract(table(spark, list(later.items()))))
    assert rows_of(store.graph(first)) == rows_of(extract.extract(table(spark, list(TREE.items()))))  # readers of the old version are not disturbed
    assert store.update(table(spark, list(later.items())))[0] == second and store.versions() == [first, second]
    # a run that died before its manifest leaves parts that nothing reads
    table(spark, [("x", "y")]).write.parquet(f"file://{tmp_path}/facts/edges/holder={second + 1}/part=0")
    third, _ = store.update(table(spark, [("a/two.py", TREE["a/two.py"])]))
    assert third == second + 2 and rows_of(store.graph()) == rows_of(extract.extract(table(spark, [("a/two.py", TREE["a/two.py"])])))
    assert store.forget() == [first, second] and len(rows_of(store.graph())[0]) == 2


def test_changes_settle_and_rebuild(spark, tmp_path):
    root, events = tmp_path / "src", f"file://{tmp_path}/events"
    for k, v in TREE.items():
        (root / k).parent.mkdir(parents=True, exist_ok=True)
        (root / k).write_text(v)
    start = datetime.datetime(2024, 1, 1, 12)
    at = lambda s: start + datetime.timedelta(seconds=s)
    store = incremental.FactStore(spark, f"file://{tmp_path}/facts", parts=4)
    read = lambda r: detect.read_tree(spark, r).select("path", "text")

    def run():
        watch.follow(watch.change_stream(spark, events, 1), read, store, f"file://{tmp_path}/check", interval=None).awaitTermination()

    seen = watch.poll(spark, f"file://{root}", None, events, at(0))
    (root / "a/two.py").write_text("def help():\n    more()\n")
    seen = watch.poll(spark, f"file://{root}", seen, events, at(2))  # within three seconds: one rebuild for both
    (root / "b/four.js").unlink()
    seen = watch.poll(spark, f"file://{root}", seen, events, at(10))
    run()
    assert store.versions() == [1]  # the last change hasn't settled
    # a change elsewhere moves the watermark on
    spark.createDataFrame([("other", "", "added", at(60))], "root string, path string, change string, ts timestamp").write.mode("append").parquet(events)
    run()
    assert rows_of(store.graph()) == rows_of(extract.extract(read(f"file://{root}")))
    assert "b/four.js" not in {r["path"] for r in store.read("files", store.versions()[-1]).collect()}


def test_settled_sessions_are_those_of_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    seconds = [0, 1, 3.5, 7, 7.5, 20, 23, 40, 41]  # a gap of three seconds or more ends a session
    for n, s in enumerate(seconds + [500]):
        spark.createDataFrame([("r" if s < 500 else "end", "p", "added", start + datetime.timedelta(seconds=s))], "root string, path string, change string, ts timestamp").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/e")
    found = []
    sessions = watch.settled(watch.change_stream(spark, f"file://{tmp_path}/e", 2))
    sessions.writeStream.foreachBatch(lambda b, n: found.extend(b.collect())).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    batch = watch.debounce(spark.read.parquet(f"file://{tmp_path}/e").filter("root = 'r'"), "3 seconds", "root").collect()
    assert sorted((r["start"], r["events"]) for r in found if r["root"] == "r") == sorted((r["start"], r["events"]) for r in batch)


def test_many_ignore_files(spark):
    rows = [(f"d{i}/.gitignore", "*.log\nx[ab].py\nout/\n[odd\n") for i in range(200)] + [(f"d{i}/k/.graphloomignore", "!keep.log\n") for i in range(200)]
    rows += [(f"d{i}/{n}", "x") for i in range(200) for n in ("a.log", "xa.py", "xc.py", "out/y.py", "k/keep.log", "k/other.log", "k/z.py")]
    left = detect.ignored(table(spark, rows).select("path"), detect.ignore_rules(table(spark, rows)))
    assert {r["path"] for r in left.collect()} == {f"d{i}/{n}" for i in range(200) for n in ("a.log", "xa.py", "out/y.py", "k/other.log")}


def test_rules_above_the_root(spark, tmp_path):
    root = tmp_path / "in" / "root"
    (root / "k").mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    (tmp_path / ".gitignore").write_text("*.py\n")
    (tmp_path / "in" / ".graphloomignore").write_text("!keep.py\nroot/k/z.js\n")
    for n in ("a.py", "keep.py", "b.js", "k/z.js"):
        (root / n).write_text("x")
    above = detect.rules_above(spark, str(root))
    assert {r["path"] for r in detect.detect(detect.read_tree(spark, str(root)), above).collect()} == {"keep.py", "b.js"}
    (tmp_path / ".gitignore").write_text("root/\n")
    (tmp_path / "in" / ".graphloomignore").write_text("root\n")
    assert detect.rules_above(spark, str(root)).count() == 0  # they would leave out the root itself
    (root / ".git").mkdir()
    assert detect.rules_above(spark, str(root)).count() == 0
