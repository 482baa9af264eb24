from pyspark.sql import functions as F

from latticework.functions.render import detailed, simplified
from latticework.operators import access, statistics
from latticework.pattern import Pred, build
from latticework.plans.compile import match
from latticework.sources import csv_headers, eav, memory, parquet


def rows(df):
    return sorted(tuple(r) for r in df.collect())


P = build([("a", "Person"), ("b", "Person")], [("k", "a", "b", "knows")], [("k", "creationDate", ">", 5)])


def people(spark):
    return memory.graph(spark, [("Person^1", "Person", {"id": 1, "name": "Ann", "score": 1.5}), ("Person^2", "Person", {"id": 2, "name": "Bob O", "score": None})], [("e1", "Person^1", "Person^2", "knows", {"creationDate": 9}), ("e2", "Person^2", "Person^1", "knows", {"creationDate": 3})])


def test_parquet_round_trip(spark, tmp_path):
    g = people(spark)
    parquet.save(g, str(tmp_path / "g"))
    back = parquet.load(spark, str(tmp_path / "g"))
    assert rows(match(back, P)) == rows(match(g, P)) == [("Person^1", "Person^2", "e1")]
    assert back.vertices_of("Person").dtypes == g.vertices_of("Person").dtypes


def test_sqlite_round_trip(spark, tmp_path):
    g = people(spark)
    eav.write_sqlite(str(tmp_path / "g.db"), g)
    back = eav.read_sqlite(spark, str(tmp_path / "g.db"))
    assert rows(match(back, P)) == rows(match(g, P))
    assert rows(back.vertices_of("Person").select("vid", "id", "name", "score")) == rows(g.vertices_of("Person").select("vid", "id", "name", "score"))


def test_attribute_rows_with_bad_values_and_several_types(spark):
    owners = spark.createDataFrame([("a",), ("b",), ("c",)], "vid string")
    attrs = spark.createDataFrame([("a", "k", "5", "int"), ("b", "k", "x", "string"), ("a", "n", "oops", "int")], "vid string, key string, value string, type string")
    out = eav.assemble(owners, attrs, "vid", [("k", "int"), ("k", "string"), ("n", "int")]).select("vid", "k.i", "k.s", "n")
    assert sorted(map(tuple, out.collect()), key=repr) == [("a", 5, None, None), ("b", None, "x", None), ("c", None, None, None)]


def test_csv_raw_headers(spark, tmp_path):
    (tmp_path / "place_0_0.csv").write_text("id|name|type\n1|Rome|city\n2|Italy|country\n")
    (tmp_path / "person_0_0.csv").write_text("id|firstName|creationDate\n7|Ann|100\n8||\n")
    (tmp_path / "person_isLocatedIn_place_0_0.csv").write_text("Person.id|Place.id\n7|1\n8|1\n7|1\n")
    (tmp_path / "person_knows_person_0_0.csv").write_text("Person.id|Person.id|creationDate\n7|8|55\n")
    g = csv_headers.graph(spark, [str(tmp_path / f) for f in ("place_0_0.csv", "person_0_0.csv")], [str(tmp_path / f) for f in ("person_isLocatedIn_place_0_0.csv", "person_knows_person_0_0.csv")], raw=True)
    assert sorted(g.vertices) == ["City", "Country", "Person"]
    assert rows(g.vertices_of("Person").select("vid", "id", "creationDate").filter("firstName is null")) == [("Person^8", 8, None)]
    assert dict(g.vertices_of("Person").dtypes)["creationDate"] == "bigint"
    p = build([("a", "Person"), ("c", "City")], [("x", "a", "c", "isLocatedIn")])
    assert [r[:2] for r in rows(match(g, p))] == [("Person^7", "Place^1"), ("Person^7", "Place^1"), ("Person^8", "Place^1")]
    assert {r[2] for r in rows(match(g, p))} == {"isLocatedIn: Person^7 -> Place^1 @ 0", "isLocatedIn: Person^7 -> Place^1 @ 1", "isLocatedIn: Person^8 -> Place^1 @ 0"}
    assert len(rows(match(g, build([("a", "Person"), ("c", "Country")], [("x", "a", "c", "isLocatedIn")])))) == 0
    assert len(rows(match(g, build([("a", "Person"), ("b", "Person")], [("x", "a", "b", "knows")], [("x", "creationDate", "=", 55)])))) == 1


def test_rendering(spark):
    g = people(spark)
    m = match(g, P)
    assert rows(simplified(m, P)) == [("(:Person Person^1)", "(:Person Person^2)", "[:knows]")]
    assert rows(detailed(m, P, g)) == [('(:Person {id: 1, name: "Ann", score: 1.5})', '(:Person {id: 2, name: "Bob O"})', "[:knows {creationDate: 9}]")]
    none = build([("a", "Nobody")])
    assert simplified(match(g, none), none).columns == ["a"] and detailed(match(g, none), none, g).count() == 0


def test_statistics(spark):
    g = people(spark)
    assert statistics.label_statistics(g) == {"v_cnt": 2, "e_cnt": 2, "v_label_cnt": {"Person": 2}, "e_label_cnt": {"knows": 2}}
    s = statistics.attribute_summary(g.vertices_of("Person"), "score").first()
    assert (s.n_rows, s.n_values, s.n_nulls, s.n_distinct, s.min_value, s.sel_eq, s.sel_ne) == (2, 1, 1, 1, 1.5, 1.0, 0.0)
    zero = spark.createDataFrame([(0,), (0,), (10,), (None,)], "x int")
    h = {r.bin: (r.low, r.high, r.n, r.sel_le) for r in statistics.histogram(zero, "x").collect()}
    assert h == {0: (0.0, 5.0, 2, 0.5), 1: (5.0, 10.0, 1, 0.75)}
    assert [tuple(r) for r in statistics.histogram(zero.filter("x = 0"), "x").select("bin", "n").collect()] == [(0, 2)]
    assert statistics.attribute_summary(zero.filter("x is null"), "x").first().sel_eq is None
    assert statistics.attribute_statistics(g).count() == 4


def test_access(spark):
    g = people(spark)
    assert [r.label for r in access.get_vertex(g, "Person^1").collect()] == ["Person"] and access.get_vertex(g, "nobody").count() == 0
    one = access.scan_vertices(g, "Person", Pred("name", "=", "Ann"))
    assert [r.eid for r in access.out_edges(g, one, "knows").collect()] == ["e1"] and [r.eid for r in access.in_edges(g, one, "knows").collect()] == ["e2"]
    assert rows(access.degrees(g.edges_of("knows"))) == [("Person^1", 1, 1), ("Person^2", 1, 1)]


def test_frequent_sets(spark):
    sets = spark.createDataFrame([(["a", "b"],), (["a", "b", "c"],), (["c"],)], "s array<string>")
    assert {(tuple(r.items_), r.freq) for r in statistics.frequent_sets(sets, "s").withColumnRenamed("items", "items_").collect()} == {(("a",), 2), (("b",), 2), (("c",), 2), (("a", "b"), 2)}


def test_streaming_edges_against_a_static_graph(spark, tmp_path):
    from latticework.streaming.matching import match_stream

    g = people(spark)
    g.edges[0].frame.write.parquet(str(tmp_path / "edges"))
    schema = g.edges[0].frame.schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "edges"))
    q = match_stream(g, P, "knows", stream).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("found").select("v_a", "v_b", "e_k")) == [("Person^1", "Person^2", "e1")]
