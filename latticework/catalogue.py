"""Registered queries of the graph engine over the relational tables, and the same in SQL.

Each entry is one capability of the engine. In SQL the graph is a set of common table expressions, ``v_<label>`` and
``e_<label>_<n>``; unused ones cost nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.identity import typed, with_edge_ids
from .functions.render import detailed, simplified
from .model import PropertyGraph
from .operators import access, statistics
from .pattern import Pred, parse
from .plans.compile import match, run_plan
from .plans.plan import from_json, make_plan
from .sources import eav, tables

# ---- patterns in their text form

PATTERNS = {
    "g1_scan_range": "1 0 1 0\nc Customer\nc acctbal <1000",
    "g2_path": "3 2 1 0\no Order\nc Customer\nn Nation\na o c placedBy\nb c n isLocatedIn\nn name ='NATION_3'",
    "g3_region_path": "3 2 1 0\nc Customer\nn Nation\nr Region\na c n isLocatedIn\nb n r isPartOf\nr name ='ASIA'",
    "g4_star": "3 2 2 0\no Order\np1 Part\np2 Part\na o p1 contains\nb o p2 contains\np1 brand ='Brand#12'\np2 brand !='Brand#12'",
    "g5_cycle": "5 5 1 0\no Order\nc Customer\ns Supplier\nn Nation\nr Region\na o c placedBy\nb c n isLocatedIn\nd o s suppliedBy\ne s n isLocatedIn\nf n r isPartOf\nr name ='ASIA'",
    "g6_edge_pred": "2 1 1 1\no Order\np Part\na o p contains\np brand ='Brand#12'\na quantity >=45",
    "g7_edge_unique": "3 2 2 0\no1 Order\no2 Order\nc Customer\na o1 c placedBy\nb o2 c placedBy\no1 priority ='1-URGENT'\no2 totalprice >450000",
    "g8_forest_cross": "2 0 0 0\ns Supplier\nr Region",
    "g9_parallel_unique": "3 2 2 0\no Order\np1 Part\np2 Part\na o p1 contains\nb o p2 contains\np1 type ='PROMO'\np2 size <=5",
    "g10_shared_vertex": "3 2 3 0\ne Event\nc Customer\no Order\nx e c triggeredBy\ny o c placedBy\ne type ='signup'\no status ='F'\ne value >=100",
    "close_cycle": "3 3 1 0\no Order\nc Customer\nn Nation\na o c placedBy\nb c n isLocatedIn\nd c n isLocatedIn\nn name ='NATION_3'",
    "multi_edge": "2 2 0 0\no Order\np Part\na o p contains\nb o p contains",
    "intersect_three": "4 3 3 0\nn Nation\nc Customer\ns Supplier\nr Region\na c n isLocatedIn\nb s n isLocatedIn\nd n r isPartOf\nr name ='ASIA'\nc acctbal <0\ns acctbal <0",
    "forest_three": "3 1 2 0\nn Nation\nr Region\ns Supplier\na n r isPartOf\nr name ='ASIA'\ns acctbal <0",
    "absent_label": "2 1 0 0\nc Customer\nx Nowhere\na c x isLocatedIn",
    "int_vs_float": "1 0 2 0\nc Customer\nc acctbal >=0\nc acctbal <=5000",
    "number_vs_text": "1 0 1 0\nc Customer\nc name !=5",
}

_MS = "epoch_ms(l_shipdate)"
_LINE = "l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, CAST(l_linenumber AS BIGINT) AS lineNumber, l_returnflag AS returnFlag, l_linestatus AS lineStatus, epoch_ms(l_shipdate) AS shipDate"


def _ctes() -> str:
    v = {
        "Region": ("region", "r_regionkey", "r_name AS name"),
        "Nation": ("nation", "n_nationkey", "n_name AS name"),
        "Customer": ("customer", "c_custkey", "c_name AS name, c_acctbal AS acctbal, c_mktsegment AS mktsegment"),
        "Supplier": ("supplier", "s_suppkey", "s_name AS name, s_acctbal AS acctbal"),
        "Part": ("part", "p_partkey", "p_name AS name, p_brand AS brand, p_type AS type, CAST(p_size AS BIGINT) AS size, p_retailprice AS retailprice"),
        "Order": ("orders", "o_orderkey", "o_orderstatus AS status, o_totalprice AS totalprice, epoch_ms(o_orderdate) AS orderdate, o_orderpriority AS priority"),
        "Event": ("events", "event_id", "epoch_ms(ts) AS ts, event_type AS type, value AS value"),
    }
    e = [
        ("isPartOf_n", "isPartOf", "Nation", "Region", "nation", "n_nationkey", "n_regionkey"),
        ("isLocatedIn_c", "isLocatedIn", "Customer", "Nation", "customer", "c_custkey", "c_nationkey"),
        ("isLocatedIn_s", "isLocatedIn", "Supplier", "Nation", "supplier", "s_suppkey", "s_nationkey"),
        ("placedBy", "placedBy", "Order", "Customer", "orders", "o_orderkey", "o_custkey"),
        ("triggeredBy", "triggeredBy", "Event", "Customer", "events", "event_id", "user_id"),
        ("contains", "contains", "Order", "Part", "lineitem", "l_orderkey", "l_partkey"),
        ("suppliedBy", "suppliedBy", "Order", "Supplier", "lineitem", "l_orderkey", "l_suppkey"),
    ]
    out = [f"v_{k} AS (SELECT '{k}^' || {key} AS vid, CAST({key} AS BIGINT) AS id, {attrs} FROM {t})" for k, (t, key, attrs) in v.items()]
    for name, label, src, dst, t, a, b in e:
        key = f"l_orderkey, l_partkey, l_suppkey, l_linenumber, {_MS}" if t == "lineitem" else f"{a}, {b}"
        extra = f", {_LINE}" if t == "lineitem" else ""
        out.append(f"e_{name} AS (SELECT concat_ws(':', '{label}', {key}) AS eid, '{src}^' || {a} AS src, '{dst}^' || {b} AS dst{extra} FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
    return "WITH " + ",\n".join(out) + "\n"


CTES = _ctes()


def _select(vs: dict[str, str], es: dict[str, str] | None = None) -> str:
    return ", ".join([f"{x} AS v_{k}" for k, x in vs.items()] + [f"{x} AS e_{k}" for k, x in (es or {}).items()])


_STAR = "FROM e_contains a JOIN e_contains b ON a.src = b.src AND a.eid <> b.eid JOIN v_Part p1 ON p1.vid = a.dst JOIN v_Part p2 ON p2.vid = b.dst"
_STAR_COLS = _select({"o": "a.src", "p1": "a.dst", "p2": "b.dst"}, {"a": "a.eid", "b": "b.eid"})
_PATH = "FROM e_isLocatedIn_c a JOIN e_isPartOf_n b ON a.dst = b.src JOIN v_Region r ON r.vid = b.dst WHERE r.name = 'ASIA'"
PATTERN_SQL = {
    "g1_scan_range": "SELECT vid AS v_c FROM v_Customer WHERE acctbal < 1000",
    "g2_path": f"SELECT {_select({'o': 'a.src', 'c': 'a.dst', 'n': 'n.vid'}, {'a': 'a.eid', 'b': 'b.eid'})} FROM e_placedBy a JOIN e_isLocatedIn_c b ON a.dst = b.src JOIN v_Nation n ON n.vid = b.dst WHERE n.name = 'NATION_3'",
    "g3_region_path": f"SELECT {_select({'c': 'a.src', 'n': 'a.dst', 'r': 'b.dst'}, {'a': 'a.eid', 'b': 'b.eid'})} {_PATH}",
    "g4_star": f"SELECT {_STAR_COLS} {_STAR} WHERE p1.brand = 'Brand#12' AND p2.brand <> 'Brand#12'",
    "g5_cycle": f"SELECT {_select({'o': 'a.src', 'c': 'a.dst', 's': 'd.dst', 'n': 'b.dst', 'r': 'f.dst'}, {'a': 'a.eid', 'b': 'b.eid', 'd': 'd.eid', 'e': 'e.eid', 'f': 'f.eid'})} FROM e_placedBy a JOIN e_isLocatedIn_c b ON b.src = a.dst JOIN e_suppliedBy d ON d.src = a.src JOIN e_isLocatedIn_s e ON e.src = d.dst AND e.dst = b.dst JOIN e_isPartOf_n f ON f.src = b.dst JOIN v_Region r ON r.vid = f.dst WHERE r.name = 'ASIA'",
    "g6_edge_pred": f"SELECT {_select({'o': 'a.src', 'p': 'a.dst'}, {'a': 'a.eid'})} FROM e_contains a JOIN v_Part p ON p.vid = a.dst WHERE p.brand = 'Brand#12' AND a.quantity >= 45",
    "g7_edge_unique": f"SELECT {_select({'o1': 'a.src', 'o2': 'b.src', 'c': 'a.dst'}, {'a': 'a.eid', 'b': 'b.eid'})} FROM e_placedBy a JOIN e_placedBy b ON a.dst = b.dst AND a.eid <> b.eid JOIN v_Order o1 ON o1.vid = a.src JOIN v_Order o2 ON o2.vid = b.src WHERE o1.priority = '1-URGENT' AND o2.totalprice > 450000",
    "g8_forest_cross": f"SELECT {_select({'s': 's.vid', 'r': 'r.vid'})} FROM v_Supplier s CROSS JOIN v_Region r",
    "g9_parallel_unique": f"SELECT {_STAR_COLS} {_STAR} WHERE p1.type = 'PROMO' AND p2.size <= 5",
    "g10_shared_vertex": f"SELECT {_select({'e': 'x.src', 'c': 'x.dst', 'o': 'y.src'}, {'x': 'x.eid', 'y': 'y.eid'})} FROM e_triggeredBy x JOIN e_placedBy y ON x.dst = y.dst JOIN v_Event e ON e.vid = x.src JOIN v_Order o ON o.vid = y.src WHERE e.type = 'signup' AND e.value >= 100 AND o.status = 'F'",
    "close_cycle": f"SELECT {_select({'o': 'a.src', 'c': 'a.dst', 'n': 'b.dst'}, {'a': 'a.eid', 'b': 'b.eid', 'd': 'd.eid'})} FROM e_placedBy a JOIN e_isLocatedIn_c b ON b.src = a.dst JOIN e_isLocatedIn_c d ON d.src = b.src AND d.dst = b.dst AND d.eid <> b.eid JOIN v_Nation n ON n.vid = b.dst WHERE n.name = 'NATION_3'",
    "multi_edge": f"SELECT {_select({'o': 'a.src', 'p': 'a.dst'}, {'a': 'a.eid', 'b': 'b.eid'})} FROM e_contains a JOIN e_contains b ON a.src = b.src AND a.dst = b.dst AND a.eid <> b.eid",
    "intersect_three": f"SELECT {_select({'n': 'a.dst', 'c': 'a.src', 's': 'b.src', 'r': 'd.dst'}, {'a': 'a.eid', 'b': 'b.eid', 'd': 'd.eid'})} FROM e_isLocatedIn_c a JOIN e_isLocatedIn_s b ON a.dst = b.dst JOIN e_isPartOf_n d ON d.src = a.dst JOIN v_Region r ON r.vid = d.dst JOIN v_Customer c ON c.vid = a.src JOIN v_Supplier s ON s.vid = b.src WHERE r.name = 'ASIA' AND c.acctbal < 0 AND s.acctbal < 0",
    "forest_three": f"SELECT {_select({'n': 'a.src', 'r': 'a.dst', 's': 's.vid'}, {'a': 'a.eid'})} FROM e_isPartOf_n a JOIN v_Region r ON r.vid = a.dst CROSS JOIN v_Supplier s WHERE r.name = 'ASIA' AND s.acctbal < 0",
    "absent_label": "SELECT vid AS v_c, vid AS v_x, vid AS e_a FROM v_Customer WHERE false",
    "int_vs_float": "SELECT vid AS v_c FROM v_Customer WHERE acctbal >= 0 AND acctbal <= 5000",
    "number_vs_text": "SELECT vid AS v_c FROM v_Customer WHERE false",
}


def _pattern_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: match(tables.graph(spark, sf_dir), PATTERNS[name])


# ---- queries beyond plain patterns: name -> (function of the graph, SQL after the common table expressions)

_G3 = PATTERNS["g3_region_path"]


def _through_json(g: PropertyGraph) -> DataFrame:
    return run_plan(g, from_json(make_plan(parse(PATTERNS["g6_edge_pred"])).to_json()))


def _eav_pivot(g: PropertyGraph) -> DataFrame:
    """Suppliers written as attribute rows and assembled again."""
    df = g.vertices_of("Supplier")
    kinds = [("id", "int"), ("name", "string"), ("acctbal", "float")]
    rows = df.select("vid", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"), F.lit(t).alias("type")) for k, t in kinds))).alias("x")).select("vid", "x.*")
    return eav.assemble(df.select("vid"), rows, "vid", kinds).select("vid", "id", "name", "acctbal")


def _eid_ordinal(g: PropertyGraph) -> DataFrame:
    e = g.edges_of("contains").select("src", "dst", "quantity", "shipDate", "price")
    return with_edge_ids(e, "contains").select("eid", "src", "dst", "quantity", "price")


def _typed_decode(g: PropertyGraph) -> DataFrame:
    c = g.vertices_of("Customer")
    return c.select("vid", typed(F.col("acctbal").cast("string"), "float").alias("as_float"), typed(F.col("name"), "int").alias("as_int"), typed(F.col("id").cast("string"), "long").alias("as_long"))


def _triangles(g: PropertyGraph) -> DataFrame:
    placed, located = g.edges_of("placedBy"), g.edges_of("isLocatedIn", "Customer", "Nation")
    supplied, of = g.edges_of("suppliedBy"), g.edges_of("isLocatedIn", "Supplier", "Nation")
    # customer -> nation, and order -> nation through its suppliers: the order's and customer's common nations
    o_n = supplied.join(of.select(F.col("src").alias("dst"), F.col("dst").alias("n")), "dst").select("src", F.col("n").alias("dst"))
    return access.triangles_by_arrays(placed, o_n, located).select(F.col("a").alias("v_o"), F.col("b").alias("v_c"), F.col("c").alias("v_n"))


def _pred(key, op, value):
    return lambda g: access.scan_vertices(g, "Part", Pred(key, op, value)).select("vid", "size")


MORE: dict[str, tuple[Callable[[PropertyGraph], DataFrame], str]] = {
    "get_vertex": (lambda g: access.get_vertex(g, "Customer^7").select("vid", "label", "id", "name"), "SELECT vid, 'Customer' AS label, id, name FROM v_Customer WHERE vid = 'Customer^7'"),
    "scan_label": (lambda g: access.scan_vertices(g, "Part"), "SELECT * FROM v_Part"),
    "scan_label_pred": (lambda g: access.scan_vertices(g, "Order", Pred("totalprice", ">", 450000)), "SELECT * FROM v_Order WHERE totalprice > 450000"),
    "scan_edges": (lambda g: access.scan_edges(g, "contains", Pred("quantity", ">=", 45)), "SELECT * FROM e_contains WHERE quantity >= 45"),
    "scan_edges_two_tables": (lambda g: access.scan_edges(g, "isLocatedIn"), "SELECT * FROM e_isLocatedIn_c UNION ALL SELECT * FROM e_isLocatedIn_s"),
    **{f"pred_{n}": (_pred("size", op, 7), f"SELECT vid, size FROM v_Part WHERE size {'<>' if op == '!=' else op} 7") for n, op in (("eq", "="), ("ne", "!="), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<="))},
    "adj_out": (lambda g: access.out_edges(g, access.scan_vertices(g, "Order", Pred("priority", "=", "1-URGENT")), "contains"), "SELECT e.* FROM e_contains e WHERE src IN (SELECT vid FROM v_Order WHERE priority = '1-URGENT')"),
    "adj_in": (lambda g: access.in_edges(g, access.scan_vertices(g, "Customer", Pred("acctbal", "<", 0)), "placedBy"), "SELECT e.* FROM e_placedBy e WHERE dst IN (SELECT vid FROM v_Customer WHERE acctbal < 0)"),
    "adj_out_dst_filter": (lambda g: access.out_edges(g, access.scan_vertices(g, "Order", Pred("status", "=", "F")), "contains", (Pred("quantity", ">", 40),), "Part", (Pred("brand", "=", "Brand#12"),)), "SELECT e.* FROM e_contains e WHERE quantity > 40 AND src IN (SELECT vid FROM v_Order WHERE status = 'F') AND dst IN (SELECT vid FROM v_Part WHERE brand = 'Brand#12')"),
    "adj_in_src_filter": (lambda g: access.in_edges(g, access.scan_vertices(g, "Nation", Pred("name", "=", "NATION_3")), "isLocatedIn", (), "Supplier", (Pred("acctbal", ">", 0),)), "SELECT e.* FROM e_isLocatedIn_s e WHERE dst IN (SELECT vid FROM v_Nation WHERE name = 'NATION_3') AND src IN (SELECT vid FROM v_Supplier WHERE acctbal > 0)"),
    "intersect_two": (lambda g: access.common_neighbours(g.edges_of("isLocatedIn", "Customer", "Nation").select(F.col("src").alias("a"), F.col("dst").alias("target")), g.edges_of("isLocatedIn", "Supplier", "Nation").select(F.col("src").alias("b"), F.col("dst").alias("target"))), "SELECT a.src AS a, b.src AS b, a.dst AS target FROM e_isLocatedIn_c a JOIN e_isLocatedIn_s b ON a.dst = b.dst"),
    "intersect_by_arrays": (_triangles, "SELECT DISTINCT a.src AS v_o, a.dst AS v_c, b.dst AS v_n FROM e_placedBy a JOIN e_isLocatedIn_c b ON b.src = a.dst JOIN e_suppliedBy d ON d.src = a.src JOIN e_isLocatedIn_s e ON e.src = d.dst AND e.dst = b.dst"),
    "adjacency_arrays": (lambda g: access.adjacency_arrays(g.edges_of("contains")).select("vid", F.size("targets").cast("long").alias("n"), F.array_join("targets", ",").alias("targets")), "SELECT src AS vid, count(DISTINCT dst) AS n, string_agg(DISTINCT dst, ',' ORDER BY dst) AS targets FROM e_contains GROUP BY src"),
    "vertex_injective": (lambda g: match(g, PATTERNS["g9_parallel_unique"], vertex_injective=True), f"SELECT {_STAR_COLS} {_STAR} WHERE p1.type = 'PROMO' AND p2.size <= 5 AND p1.vid <> p2.vid"),
    "given_order": (lambda g: match(g, PATTERNS["g5_cycle"], order=["s", "c", "o", "n", "r"]), PATTERN_SQL["g5_cycle"]),
    "declared_order": (lambda g: match(g, PATTERNS["g10_shared_vertex"], optimize=False), PATTERN_SQL["g10_shared_vertex"]),
    "ordered_by_statistics": (lambda g: match(g, PATTERNS["g2_path"], stats=statistics.label_statistics(g)), PATTERN_SQL["g2_path"]),
    "leaf_merge": (lambda g: match(g, PATTERNS["g7_edge_unique"], order=["o1", "o2", "c"]), PATTERN_SQL["g7_edge_unique"]),
    "join_merge_hint": (lambda g: match(g, _G3, join_hint="merge"), PATTERN_SQL["g3_region_path"]),
    "join_hash_hint": (lambda g: match(g, _G3, join_hint="shuffle_hash"), PATTERN_SQL["g3_region_path"]),
    "plan_json": (_through_json, PATTERN_SQL["g6_edge_pred"]),
    "render_simple": (lambda g: simplified(match(g, _G3), parse(_G3)), f"SELECT '(:Customer ' || a.src || ')' AS c, '(:Nation ' || a.dst || ')' AS n, '(:Region ' || b.dst || ')' AS r, '[:isLocatedIn]' AS a, '[:isPartOf]' AS b {_PATH}"),
    "render_detailed": (lambda g: detailed(match(g, _G3), parse(_G3), g).select("n", "r", "a", "b"), f"SELECT '(:Nation {{id: ' || nn.id || ', name: \"' || nn.name || '\"}})' AS n, '(:Region {{id: ' || r.id || ', name: \"' || r.name || '\"}})' AS r, '[:isLocatedIn {{}}]' AS a, '[:isPartOf {{}}]' AS b FROM e_isLocatedIn_c a JOIN e_isPartOf_n b ON a.dst = b.src JOIN v_Region r ON r.vid = b.dst JOIN v_Nation nn ON nn.vid = a.dst WHERE r.name = 'ASIA'"),
    "label_counts": (statistics.label_counts, "SELECT 'vertex' AS kind, label, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS label FROM v_{x}" for x in tables.VERTICES) + ") GROUP BY label UNION ALL SELECT 'edge' AS kind, label, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS label FROM e_{y}" for x, y in (("isPartOf", "isPartOf_n"), ("isLocatedIn", "isLocatedIn_c"), ("isLocatedIn", "isLocatedIn_s"), ("placedBy", "placedBy"), ("triggeredBy", "triggeredBy"), ("contains", "contains"), ("suppliedBy", "suppliedBy"))) + ") GROUP BY label"),
    "total_counts": (lambda g: statistics.label_counts(g).groupBy("kind").agg(F.sum("n").alias("n")), "SELECT 'vertex' AS kind, CAST((SELECT count(*) FROM v_Region) + (SELECT count(*) FROM v_Nation) + (SELECT count(*) FROM v_Customer) + (SELECT count(*) FROM v_Supplier) + (SELECT count(*) FROM v_Part) + (SELECT count(*) FROM v_Order) + (SELECT count(*) FROM v_Event) AS BIGINT) AS n UNION ALL SELECT 'edge', CAST((SELECT count(*) FROM e_isPartOf_n) + (SELECT count(*) FROM e_isLocatedIn_c) + (SELECT count(*) FROM e_isLocatedIn_s) + (SELECT count(*) FROM e_placedBy) + (SELECT count(*) FROM e_triggeredBy) + (SELECT count(*) FROM e_contains) + (SELECT count(*) FROM e_suppliedBy) AS BIGINT)"),
    "attr_stats": (lambda g: statistics.attribute_summary(g.vertices_of("Order"), "totalprice"), "SELECT 'totalprice' AS attr, count(*) AS n_rows, count(totalprice) AS n_values, count(*) - count(totalprice) AS n_nulls, count(DISTINCT totalprice) AS n_distinct, min(totalprice) AS min_value, max(totalprice) AS max_value, 1.0::DOUBLE / count(DISTINCT totalprice) AS sel_eq, 1 - 1.0::DOUBLE / count(DISTINCT totalprice) AS sel_ne FROM v_Order"),
    "selectivity": (lambda g: statistics.attribute_summary(g.vertices_of("Customer"), "mktsegment").select("attr", "n_distinct", "sel_eq", "sel_ne"), "SELECT 'mktsegment' AS attr, count(DISTINCT mktsegment) AS n_distinct, 1.0::DOUBLE / count(DISTINCT mktsegment) AS sel_eq, 1 - 1.0::DOUBLE / count(DISTINCT mktsegment) AS sel_ne FROM v_Customer"),
    "attr_histogram": (lambda g: statistics.histogram(g.vertices_of("Part"), "size").select("bin", "n", F.round("sel_le", 9).alias("sel_le")), "SELECT bin, n, round(sum(n) OVER (ORDER BY bin) / total, 9) AS sel_le FROM (SELECT CAST(least(floor((size - lo) / ((hi - lo) / least(10, ndv))), least(10, ndv) - 1) AS INTEGER) AS bin, count(*) AS n, max(total)::DOUBLE AS total FROM v_Part, (SELECT min(size)::DOUBLE AS lo, max(size)::DOUBLE AS hi, count(DISTINCT size) AS ndv, count(*) AS total FROM v_Part) GROUP BY 1)"),
    "value_counts": (lambda g: statistics.value_counts(g.vertices_of("Event"), "type"), "SELECT type AS value, count(*) AS n FROM v_Event WHERE type IS NOT NULL GROUP BY type"),
    "degree": (lambda g: access.degrees(g.edges_of("placedBy")), "SELECT vid, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS vid, 1 AS o, 0 AS i FROM e_placedBy UNION ALL SELECT dst, 0, 1 FROM e_placedBy) GROUP BY vid"),
    "eid_ordinal": (_eid_ordinal, "SELECT 'contains: ' || src || ' -> ' || dst || ' @ ' || (row_number() OVER (PARTITION BY src, dst ORDER BY quantity, shipDate, price) - 1) AS eid, src, dst, quantity, price FROM e_contains"),
    "eav_pivot": (_eav_pivot, "SELECT vid, id, name, acctbal FROM v_Supplier"),
    "typed_decode": (_typed_decode, "SELECT vid, acctbal AS as_float, CAST(NULL AS BIGINT) AS as_int, id AS as_long FROM v_Customer"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(tables.graph(spark, sf_dir), _G3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _pattern_query(name) for name in PATTERNS}
    return out | {name: (lambda spark, sf_dir, f=f: f(tables.graph(spark, sf_dir))) for name, (f, _) in MORE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: CTES + sql for name, sql in PATTERN_SQL.items()} | {name: CTES + sql for name, (_, sql) in MORE.items()}
