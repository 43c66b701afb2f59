"""Small graphs that the tests share."""

from graphloom.operators.graph import PropertyGraph, overwrite_edges
from graphloom.schema import NODE

SERVER_NODES = [
    ("main_go", "main.go", "main.go", "", [], None, []),
    ("handler_go", "handler.go", "handler.go", "", [], None, []),
    ("main_main", "main()", "main.go", "L10", ["throws"], "Entry point", []),
    ("main_server", "Server", "main.go", "L20", [], None, []),
    ("main_server_start", ".Start()", "main.go", "L30", ["net", "async"], None, []),
    ("main_server_stop", ".Stop()", "main.go", "L50", ["logs"], None, ["server shutting down"]),
    ("handler_handlerequest", "HandleRequest()", "handler.go", "L5", ["net", "logs"], None, []),
    ("handler_validateinput", "ValidateInput()", "handler.go", "L40", ["throws"], None, []),
    ("go_pkg_fmt", "fmt", "", "", [], None, []),
]
SERVER_EDGES = [
    ("main_go", "main_main", "contains", "EXTRACTED", 1.0),
    ("main_go", "main_server", "contains", "EXTRACTED", 1.0),
    ("handler_go", "handler_handlerequest", "contains", "EXTRACTED", 1.0),
    ("handler_go", "handler_validateinput", "contains", "EXTRACTED", 1.0),
    ("main_server", "main_server_start", "method", "EXTRACTED", 1.0),
    ("main_server", "main_server_stop", "method", "EXTRACTED", 1.0),
    ("main_go", "go_pkg_fmt", "imports", "EXTRACTED", 1.0),
    ("main_main", "main_server", "calls", "EXTRACTED", 1.0),
    ("main_server_start", "handler_handlerequest", "calls", "EXTRACTED", 1.0),
    ("handler_handlerequest", "handler_validateinput", "calls", "EXTRACTED", 1.0),
    ("main_server_start", "handler_handlerequest", "calls", "INFERRED", 1.0),
    ("handler_validateinput", "go_pkg_fmt", "references", "AMBIGUOUS", 0.5),
]
SERVER_COMMUNITIES = {0: ["main_go", "main_main", "main_server", "main_server_start", "main_server_stop", "go_pkg_fmt"], 1: ["handler_go", "handler_handlerequest", "handler_validateinput"]}


def edges_of(spark, rows):
    """(source, target, relation[, confidence[, weight]])"""
    full = [(*r, *("EXTRACTED", 1.0)[len(r) - 3 :], i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "source string, target string, relation string, confidence string, weight double, ord long")


def server(spark) -> PropertyGraph:
    nodes = spark.createDataFrame([(i, label, "code", f, loc, tags, comment, None, logs, []) for i, label, f, loc, tags, comment, logs in SERVER_NODES], NODE)
    return PropertyGraph(nodes, overwrite_edges(edges_of(spark, SERVER_EDGES)))


def communities(spark, groups=SERVER_COMMUNITIES):
    return spark.createDataFrame([(n, c) for c, members in groups.items() for n in members], "node_id string, community_id int")


def small(spark, edges, labels=None, extra=()):
    ids = sorted({x for e in edges for x in e[:2]} | set(extra))
    nodes = spark.createDataFrame([(i, (labels or {}).get(i, i), "code", "", "", [], None, None, [], []) for i in ids], NODE)
    return PropertyGraph(nodes, overwrite_edges(edges_of(spark, edges))) if edges else PropertyGraph(nodes, overwrite_edges(edges_of(spark, [("a", "b", "calls")]).limit(0)))
