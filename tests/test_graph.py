from pyspark.sql import functions as F

from graphloom.operators import analyze, community, search, traverse
from graphloom.operators.graph import PropertyGraph, merge_semantic, upsert_nodes
from graphloom.operators.points import GraphTools, RecordTools
from graphloom.operators.validate import validate
from graphs import SERVER_EDGES, communities, edges_of, server, small


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_counts_and_overwrite(spark):
    g = server(spark)
    assert g.counts().first().asDict() == {"node_count": 9, "edge_count": 11, "edge_count_halved": 11}
    stats = analyze.graph_stats(g)
    assert dict(stats["confidence"].collect()) == {"EXTRACTED": 9, "INFERRED": 1, "AMBIGUOUS": 1}
    assert dict(stats["relation"].collect()) == {"contains": 4, "calls": 3, "method": 2, "imports": 1, "references": 1}
    assert dict(stats["tag"].collect()) == {"throws": 2, "net": 2, "async": 1, "logs": 2}


def test_degrees_and_hubs(spark):
    g = server(spark)
    assert dict(g.degrees().collect()) == {"main_server": 4, "main_go": 3, "handler_handlerequest": 3, "handler_validateinput": 3, "handler_go": 2, "main_main": 2, "main_server_start": 2, "go_pkg_fmt": 2, "main_server_stop": 1}
    assert [(r["label"], r["degree"]) for r in analyze.god_nodes(g, 3).collect()] == [("Server", 4), ("HandleRequest()", 3), ("ValidateInput()", 3)]
    hubs = analyze.hub_nodes(g.nodes, edges_of(spark, SERVER_EDGES), 1).first()
    assert (hubs["id"], hubs["degree"]) == ("handler_handlerequest", 4)


def test_loops_count_once(spark):
    g = small(spark, [("a", "a", "calls"), ("a", "b", "calls")])
    assert dict(g.degrees().collect()) == {"a": 2, "b": 1} and g.counts().first()["edge_count_halved"] == 1


def test_paths(spark):
    g = server(spark)
    adjacency = g.adjacency()
    assert traverse.shortest_path(adjacency, "main_main", "handler_validateinput") == ["main_main", "main_go", "go_pkg_fmt", "handler_validateinput"]
    assert traverse.shortest_path(adjacency, "main_main", "handler_validateinput", 2) is None
    assert traverse.shortest_path(adjacency, "nowhere", "nowhere") == ["nowhere"]
    assert traverse.shortest_path(adjacency, "nowhere", "main_go") is None


def test_trace(spark):
    g = server(spark)
    chains = traverse.names_of(traverse.trace_tag(g, "throws"), g.nodes).collect()
    assert [[s["label"] for s in r["path"]] for r in chains] == [[".Start()", "HandleRequest()", "ValidateInput()"]]
    assert traverse.trace_tag(g, "unsafe").count() == 0
    assert [r["path"] for r in traverse.trace_tag(g, "throws", 1).collect()] == [["handler_handlerequest", "handler_validateinput"]]


def test_trace_through_a_cycle_ends(spark):
    g = small(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls")])
    g.nodes = g.nodes.withColumn("tags", F.when(F.col("id") == "a", F.array(F.lit("fs"))).otherwise(F.array().cast("array<string>")))
    assert [r["path"] for r in traverse.trace_tag(g, "fs").collect()] == [["b", "c", "a"]]


def test_bfs_and_impact(spark):
    g = server(spark)
    visited, edges = traverse.bfs(g, spark.createDataFrame([("main_server",), ("missing",)], "id string"), 1)
    assert ids(visited) == ["main_go", "main_main", "main_server", "main_server_start", "main_server_stop"] and edges.count() == 4
    found = traverse.impact(g, spark.createDataFrame([("main_server_stop",), ("main_server",)], "id string"), 1).collect()
    assert [(r["id"], r["affected"]) for r in found] == [("main_server", 4), ("main_server_stop", 1)]


def test_surprises_and_questions(spark):
    g = server(spark)
    rows = analyze.surprising_connections(g, communities(spark), 5).collect()
    assert [(r["source"], r["score"], r["why"]) for r in rows[:2]] == [
        ("main_server_start", 5, "inferred connection; crosses files; bridges separate communities"),
        ("handler_validateinput", 4, "tagged AMBIGUOUS; bridges separate communities"),
    ]
    assert [r["score"] for r in rows[2:]] == [1, 1]
    assert ids(analyze.suggest_questions(g, 5), "kind") == ["ambiguous_edge"]
    lone = small(spark, [("a", "b", "calls")], extra=["x", "y"])
    assert analyze.suggest_questions(lone, 5).first()["question"] == "Why are these entities disconnected: x, y?"


def test_cohesion_nmi_and_clusters(spark):
    g = server(spark)
    scores = {r["community_id"]: r["cohesion"] for r in community.cohesion(g, communities(spark)).collect()}
    assert scores == {0: 0.4, 1: 1.0}
    p = communities(spark, {0: ["a", "b"], 1: ["c", "d"], 2: ["e", "f"]})
    assert abs(community.nmi(p, p).first()["nmi"] - 1) < 1e-12
    assert community.nmi(communities(spark, {0: ["a", "b"]}), communities(spark, {0: ["a", "b"]})).first()["nmi"] == 0
    two = small(spark, [(x + a, x + b, "calls") for x in "pq" for i, a in enumerate("1234") for b in "1234"[i + 1 :]] + [("p1", "q1", "calls")], extra=["lone"])
    found = {}
    for r in community.cluster(two).collect():
        found.setdefault(r["community_id"], set()).add(r["node_id"])
    assert found == {0: {"p1", "p2", "p3", "p4"}, 1: {"q1", "q2", "q3", "q4"}, 2: {"lone"}}
    splits, merges, stable = community.splits_and_merges(communities(spark, {0: ["a", "b", "c", "d"]}), communities(spark, {5: ["a", "b"], 6: ["c", "d"]}))
    assert splits.first()["parts"] == [5, 6] and merges.count() == 0 and stable.first()["jaccard"] == 0.5


def test_build_upsert_and_dangling(spark):
    records = spark.createDataFrame([("A.b", "one", "code", 1), ("A.b", None, "code", 2), ("c", "see", "code", 3)], "id string, label string, file_type string, ord long")
    assert {r["id"]: r["label"] for r in upsert_nodes(records).collect()} == {"A.b": "one", "c": "see"}
    g = PropertyGraph.build(records, edges_of(spark, [("a-b", "C", "calls"), ("c", "gone", "imports"), ("c", "A.b", "references")]))
    assert [(r["source"], r["target"], r["relation"]) for r in g.edges.collect()] == [("c", "A.b", "references")]
    both = PropertyGraph.union([(records, edges_of(spark, [("a_b", "c", "calls")])), (records, edges_of(spark, [("c", "a_b", "method")]))])
    assert both.edges.first()["relation"] == "method"


def test_edits(spark):
    g = server(spark)
    assert g.remove_node("main_server").counts().first().asDict() == {"node_count": 8, "edge_count": 7, "edge_count_halved": 7}
    sub = g.subgraph(spark.createDataFrame([("main_go",), ("main_server",), ("nobody",)], "id string"))
    assert sub.nodes.count() == 2 and sub.edges.count() == 1
    more = g.add_edges(edges_of(spark, [("main_go", "fresh", "calls")]))
    assert more.has_node("fresh") and more.counts().first()["edge_count"] == 12
    named = g.add_nodes(spark.createDataFrame([("main_go", "renamed", 1)], "id string, label string, ord long"))
    assert named.nodes.filter("id = 'main_go'").first()["label"] == "renamed" and named.nodes.filter("id = 'main_go'").first()["source_file"] == "main.go"
    assert g.rekey(spark.createDataFrame([("main_go", "M")], "id_b string, id_a string")).edges.filter("source = 'M'").count() == 3
    arcs = PropertyGraph(g.nodes, edges_of(spark, [("a", "b", "x"), ("b", "a", "y")]).drop("ord").withColumns({"lo": F.lit("a"), "hi": F.lit("b")}), True)
    assert arcs.to_undirected().edges.first()["relation"] == "y"


def test_merge_replaces_whole_nodes(spark):
    ast = spark.createDataFrame([("a", "A", "x", 0), ("a", "A2", "x", 1), ("b", "B", "y", 2)], "id string, label string, comment string, ord long")
    sem = spark.createDataFrame([("b", "B!", None, 0), ("n", "N", None, 1)], "id string, label string, comment string, ord long")
    assert [(r["id"], r["label"], r["comment"]) for r in merge_semantic(ast, sem).orderBy("ord").collect()] == [("a", "A", "x"), ("a", "A2", "x"), ("b", "B!", None), ("n", "N", None)]


def test_validate(spark):
    nodes = spark.createDataFrame([("a", "A", "code"), (None, "", "film")], "id string, label string, file_type string")
    edges = spark.createDataFrame([("a", "z", None, "SURE", "")], "source string, target string, relation string, confidence string, source_file string")
    kinds = sorted((r["kind"], r["message"]) for r in validate(nodes, edges).collect())
    assert kinds == [("dangling_target", "z"), ("edge_bad_confidence", "SURE"), ("edge_missing", "relation"), ("edge_missing", "source_file"), ("node_bad_file_type", "film"), ("node_missing", "id"), ("node_missing", "label")]


def test_search(spark):
    labels = {"server": "Server", "new_server": "NewServer()", "start": ".Start()", "client": "Client", "handler": "Handler", "auth": "Authenticate()", "café": "Café"}
    g = small(spark, [("server", x, "r") for x in ("new_server", "start", "handler", "client", "auth")] + [("client", "handler", "r")], labels, ["café"])
    assert ids(search.score_nodes(g, "server"))[0] == "server"
    assert ids(search.score_nodes(g, "auth"))[0] == "auth"
    assert "handler" in ids(search.score_nodes(g, "handlr")) and ids(search.score_nodes(g, "cafe"))[0] == "café"
    assert search.score_nodes(g, "  ").count() == 0
    stage = lambda x: search.find_node(g.nodes, x).first()
    assert (stage("start")["stage"], stage("CLIENT")["id"], stage("cafe")["id"], stage("handlre")["id"]) == (0, "client", "café", "handler")
    assert stage("nothing at all") is None


def test_point_queries(spark):
    t = GraphTools(server(spark), communities(spark))
    assert ids(t.list_roots()) == ["handler_go", "main_go"]
    assert ids(t.list_leaves()) == ["handler_handlerequest", "handler_validateinput", "main_main", "main_server_start", "main_server_stop"]
    assert ids(t.list_leaves("throws")) == ["handler_validateinput", "main_main"]
    assert t.get_node("Server").first()["parents"] == ["main_go"] and t.get_node("zzzzzzzz").count() == 0
    assert ids(t.get_children("Server")) == ["main_server_start", "main_server_stop"]
    assert ids(t.get_neighbors("Server", "method"), "peer") == ["main_server_start", "main_server_stop"]
    assert t.community_info(0).first()["cohesion"] == 0.4 and t.community_info().count() == 2
    assert ids(t.list_nodes(tag="net")) == ["handler_handlerequest", "main_server_start"]
    assert t.get_subgraph(["Server"], 1).nodes.count() == 5 and t.query("server").count() > 3
    r = RecordTools(t.graph.nodes, edges_of(spark, SERVER_EDGES))
    assert ids(r.callers("handler_handlerequest")) == ["main_server_start"] and ids(r.callees("main_main")) == ["main_server"]
    assert ids(r.roots()) == ["handler_go", "main_go"] and ids(r.leaves()) == ["go_pkg_fmt", "main_server_stop"]
    assert [n for n, _ in r.path("main_main", "handler_validateinput")] == ["main_main", "main_go", "go_pkg_fmt", "handler_validateinput"]
    assert ids(r.search_comments("shutting")) == ["main_server_stop"] and ids(r.search_nodes("validate"))[0] == "handler_validateinput"
    assert r.subgraph("main_server", 1).count() == 5 and ids(r.walk_chain("main_go", "contains")) == ["main_go", "main_main", "main_server"]


def test_ranks_go_on_across_ranges(spark):
    from graphloom.operators.rounds import ranked

    rows = spark.createDataFrame([(i % 7, f"n{i:03d}") for i in range(200)], "n int, least string").repartition(5)
    got = sorted(ranked(rows, "place", F.desc("n"), F.asc("least")).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(200))
    assert [(r.n, r.least) for r in got] == sorted(((r.n, r.least) for r in got), key=lambda x: (-x[0], x[1]))
    assert ranked(rows.limit(0), "place", "n").count() == 0


def test_a_sweep_reads_only_the_edges_of_nodes_that_may_move(spark, monkeypatch):
    from graphloom.operators import community

    tables, cut = [], community.cut
    monkeypatch.setattr(community, "cut", lambda df: tables.append(cut(df)) or tables[-1])
    edges = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(6) for j in range(i)], "source string, target string")
    assert {r["id"] for r in community.local_moving(edges, 1).collect()} == {f"n{i}" for i in range(6)}
    whole, *halves = (sorted((r["id"], r["peer"]) for r in t.collect()) for t in tables[:3])
    assert sorted(halves[0] + halves[1]) == whole and not {x for x, _ in halves[0]} & {x for x, _ in halves[1]}
