from graphloom.operators import align
from graphloom.plans import text_and_shape
from graphs import small

SF = "/root/testdata/sf0.001"


def test_renamed_parts_are_found(spark):
    got = {r["id_a"]: r["id_b"] for r in text_and_shape.graph_alignment(spark, SF).collect()}
    parts = [r["p_partkey"] for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    old = [f"part_{k}_old" for k in parts if k % 10 == 7]
    assert old and all(got[f"part_{k}"] == f"part_{k}" for k in parts if k % 10 != 7)
    assert {got.get(k) for k in old} == {k.removesuffix("_old") for k in old}
    assert any(k.startswith("customer") for k in got) and any(k.startswith("order") for k in got)


def test_equal_nodes_pair_as_the_greedy_order_does(spark, monkeypatch):
    def star(prefix, n):
        edges = [(f"{prefix}root", f"{prefix}{i}", "contains") for i in range(n)]
        return small(spark, edges, {f"{prefix}{i}": ("loadFile()" if i % 2 else "saveFile()") for i in range(n)} | {f"{prefix}root": "main"})

    a, b = star("a", 5), star("b", 7)
    fast = sorted(map(tuple, align.align(a, b).collect()))
    monkeypatch.setattr(align, "_equals", lambda sa, sb: sa.select("id_a").crossJoin(sb.select("id_b")).limit(0).selectExpr("id_a", "id_b", "1.0D AS score"))
    assert fast == sorted(map(tuple, align.align(a, b).collect())) and len(fast) == 6
