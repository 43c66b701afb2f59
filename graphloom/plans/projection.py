"""A property graph over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph, overwrite_edges

CUTOFF = "1997-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, file_type, source_file, tags."""

    def part(table, kind, key, label, file, tags=None, file_type="code"):
        tags = F.array(tags) if tags is not None else F.array().cast("array<string>")
        return read(spark, sf_dir, table).select(_id(kind, key).alias("id"), label.alias("label"), F.lit(file_type).alias("file_type"), file.alias("source_file"), tags.alias("tags"))

    parts = [
        part("region", "region", "r_regionkey", F.col("r_name"), F.lit("geo.tbl")),
        part("nation", "nation", "n_nationkey", F.concat("n_name", F.lit("()")), F.lit("geo.tbl")),
        part("supplier", "supplier", "s_suppkey", F.col("s_name"), F.lit("supplier.tbl")),
        part("customer", "customer", "c_custkey", F.col("c_name"), F.concat("c_mktsegment", F.lit(".tbl")), F.lower("c_mktsegment")),
        part("part", "part", "p_partkey", F.col("p_name"), F.col("p_brand"), F.lower("p_type")),
        part("orders", "order", "o_orderkey", F.concat(F.lit("order."), "o_orderstatus"), F.lit("orders.tbl"), F.lower("o_orderpriority"), "document"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record: source, target, relation, confidence, weight, ord. Lines of an order may share all four
    keys, so weight and confidence complete the order."""

    def part(table, source, target, relation, confidence, weight, *ord_):
        ord_ = [F.col(o).cast("long") for o in ord_] + [F.lit(0).cast("long")] * (4 - len(ord_))
        named = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(ord_)], weight.cast("double").alias("weight"), confidence.alias("confidence"))
        return read(spark, sf_dir, table).select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), confidence.alias("confidence"), weight.cast("double").alias("weight"), named.alias("ord"))

    one, sure = F.lit(1.0), F.lit("EXTRACTED")
    by_flag = F.when(F.col("l_returnflag") == "N", "EXTRACTED").when(F.col("l_returnflag") == "R", "INFERRED").otherwise("AMBIGUOUS")
    return (
        part("nation", _id("region", "n_regionkey"), _id("nation", "n_nationkey"), "contains", sure, one, "n_nationkey")
        .unionByName(part("customer", _id("nation", "c_nationkey"), _id("customer", "c_custkey"), "contains", sure, one, "c_custkey"))
        .unionByName(part("supplier", _id("nation", "s_nationkey"), _id("supplier", "s_suppkey"), "contains", sure, one, "s_suppkey"))
        .unionByName(part("orders", _id("customer", "o_custkey"), _id("order", "o_orderkey"), "calls", F.lit("INFERRED"), one, "o_orderkey"))
        .unionByName(part("lineitem", _id("supplier", "l_suppkey"), _id("part", "l_partkey"), "imports", by_flag, F.col("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    )


_stored: dict[tuple, PropertyGraph] = {}


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of what lies in the folder of tables, two levels deep."""
    jvm = spark._jvm
    conf = spark._jsparkSession.sparkContext().hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(sf_dir)
    system = folder.getFileSystem(conf)
    found = []
    for s in system.listStatus(folder):
        inside = system.listStatus(s.getPath()) if s.isDirectory() else [s]
        found += [(x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in inside]
    return tuple(sorted(found))


def _once(spark: SparkSession, sf_dir: str, version: str, build) -> PropertyGraph:
    """The stored graph of a version of the tables; each session builds it once, and again if the tables' files change."""
    key = (spark.sparkContext.applicationId, sf_dir, version, stamp(spark, sf_dir))
    if key not in _stored:
        _stored[key] = build().stored()
    return _stored[key]


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Ids here are already normal and every endpoint is a node, so only the overwrite is left to do."""
    return _once(spark, sf_dir, "now", lambda: PropertyGraph(nodes(spark, sf_dir), overwrite_edges(raw_edges(spark, sf_dir))))


def earlier(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """An older version: without orders from CUTOFF on and without parts whose key ends in 7, which
    were then called otherwise."""
    return _once(spark, sf_dir, "earlier", lambda: _earlier(spark, sf_dir))


def _earlier(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    late = read(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= CUTOFF).select(_id("order", "o_orderkey").alias("id"))
    old = lambda c: F.when(F.col(c).rlike("^part_[0-9]*7$"), F.concat(c, F.lit("_old"))).otherwise(F.col(c))
    now = graph(spark, sf_dir)
    kept = now.nodes.join(late, "id", "left_anti").withColumn("id", old("id"))
    edges = now.edges.join(late, F.col("target") == late["id"], "left_anti").withColumn("target", old("target"))
    return PropertyGraph(kept, edges.withColumns({"lo": F.least("source", "target"), "hi": F.greatest("source", "target")}))


def by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed partition: customers and suppliers by nation, parts by size, the rest by region."""
    take = lambda t, kind, key, c: read(spark, sf_dir, t).select(_id(kind, key).alias("node_id"), c.cast("int").alias("community_id"))
    return (
        take("customer", "customer", "c_custkey", F.col("c_nationkey"))
        .unionByName(take("supplier", "supplier", "s_suppkey", F.col("s_nationkey")))
        .unionByName(take("part", "part", "p_partkey", F.col("p_size") + 100))
        .unionByName(take("nation", "nation", "n_nationkey", F.col("n_nationkey")))
    )


def by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarser partition of the same nodes."""
    region = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("community_id"), F.col("n_regionkey").alias("r"))
    fine = by_nation(spark, sf_dir)
    return fine.join(region, "community_id", "left").select("node_id", F.coalesce("r", F.floor(F.col("community_id") / 25).cast("int")).alias("community_id"))


# ---- the same for the SQL side -------------------------------------------------------------

SQL = """
nodes AS (
  SELECT 'region_' || r_regionkey AS id, r_name AS label, 'code' AS file_type, 'geo.tbl' AS source_file, []::VARCHAR[] AS tags FROM region
  UNION ALL SELECT 'nation_' || n_nationkey, n_name || '()', 'code', 'geo.tbl', []::VARCHAR[] FROM nation
  UNION ALL SELECT 'supplier_' || s_suppkey, s_name, 'code', 'supplier.tbl', []::VARCHAR[] FROM supplier
  UNION ALL SELECT 'customer_' || c_custkey, c_name, 'code', c_mktsegment || '.tbl', [lower(c_mktsegment)] FROM customer
  UNION ALL SELECT 'part_' || p_partkey, p_name, 'code', p_brand, [lower(p_type)] FROM part
  UNION ALL SELECT 'order_' || o_orderkey, 'order.' || o_orderstatus, 'document', 'orders.tbl', [lower(o_orderpriority)] FROM orders),
raw AS (
  SELECT 'region_' || n_regionkey AS source, 'nation_' || n_nationkey AS target, 'contains' AS relation, 'EXTRACTED' AS confidence, 1.0::DOUBLE AS weight, n_nationkey::BIGINT AS k0, 0::BIGINT AS k1, 0::BIGINT AS k2, 0::BIGINT AS k3 FROM nation
  UNION ALL SELECT 'nation_' || c_nationkey, 'customer_' || c_custkey, 'contains', 'EXTRACTED', 1.0::DOUBLE, c_custkey, 0, 0, 0 FROM customer
  UNION ALL SELECT 'nation_' || s_nationkey, 'supplier_' || s_suppkey, 'contains', 'EXTRACTED', 1.0::DOUBLE, s_suppkey, 0, 0, 0 FROM supplier
  UNION ALL SELECT 'customer_' || o_custkey, 'order_' || o_orderkey, 'calls', 'INFERRED', 1.0::DOUBLE, o_orderkey, 0, 0, 0 FROM orders
  UNION ALL SELECT 'supplier_' || l_suppkey, 'part_' || l_partkey, 'imports', CASE l_returnflag WHEN 'N' THEN 'EXTRACTED' WHEN 'R' THEN 'INFERRED' ELSE 'AMBIGUOUS' END, l_quantity::DOUBLE, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
edges AS (
  SELECT least(source, target) AS lo, greatest(source, target) AS hi, source, target, relation, confidence, weight FROM raw
  QUALIFY row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY k0 DESC, k1 DESC, k2 DESC, k3 DESC, weight DESC, confidence DESC) = 1),
adj AS (SELECT source AS id, target AS peer FROM edges UNION SELECT target, source FROM edges),
degrees AS (SELECT n.id, count(a.peer) AS degree FROM nodes n LEFT JOIN adj a ON a.id = n.id GROUP BY n.id),
tree AS (SELECT source AS parent, target AS child FROM edges WHERE relation IN ('contains', 'method'))
"""

EARLIER_SQL = f"""
late AS (SELECT 'order_' || o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '{CUTOFF}'),
a_nodes AS (
  SELECT CASE WHEN regexp_matches(id, '^part_[0-9]*7$') THEN id || '_old' ELSE id END AS id, label, file_type, source_file, tags
  FROM nodes WHERE id NOT IN (SELECT id FROM late)),
a_moved AS (
  SELECT source, CASE WHEN regexp_matches(target, '^part_[0-9]*7$') THEN target || '_old' ELSE target END AS target, relation, confidence, weight
  FROM edges WHERE target NOT IN (SELECT id FROM late)),
a_edges AS (SELECT least(source, target) AS lo, greatest(source, target) AS hi, * FROM a_moved),
a_adj AS (SELECT source AS id, target AS peer FROM a_edges UNION SELECT target, source FROM a_edges),
a_degrees AS (SELECT n.id, count(a.peer) AS degree FROM a_nodes n LEFT JOIN a_adj a ON a.id = n.id GROUP BY n.id)
"""

PARTITION_SQL = """
fine AS (
  SELECT 'customer_' || c_custkey AS node_id, c_nationkey::INTEGER AS community_id FROM customer
  UNION ALL SELECT 'supplier_' || s_suppkey, s_nationkey::INTEGER FROM supplier
  UNION ALL SELECT 'part_' || p_partkey, (p_size + 100)::INTEGER FROM part
  UNION ALL SELECT 'nation_' || n_nationkey, n_nationkey::INTEGER FROM nation),
coarse AS (
  SELECT node_id, coalesce(n_regionkey, community_id // 25)::INTEGER AS community_id
  FROM fine LEFT JOIN nation ON n_nationkey = community_id)
"""

FILE_LABEL_SQL = r"(regexp_matches({0}, '\.[^./]{{0,4}}$') AND NOT contains({0}, '()'))"
