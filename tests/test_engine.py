from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraflux.functions import st
from terraflux.operators import aggregates, joins, tracks
from terraflux.plans.ecql import Layout, ecql, visible
from terraflux.plans.query import Query, Refused, at_most, explain, graduated, no_full_scan, run
from terraflux.sources import convert as C
from terraflux.sources import export, storage
from terraflux.streaming.live import LiveTable, latest_state
from terraflux.types import FeatureType


def test_feature_type_round_trip():
    spec = "name:String:index=true,age:Int,dtg:Date,tags:List[String],m:Map[String,Int],*geom:Point:srid=4326;k=v"
    ft = FeatureType.parse("t", spec)
    assert ft.encode() == spec
    assert ft.geometry.name == "geom" and ft.date.name == "dtg"
    schema = ft.schema()
    assert [f.name for f in schema][0] == "__fid__" and not schema["__fid__"].nullable
    assert schema["m"].dataType == T.MapType(T.StringType(), T.IntegerType())
    assert FeatureType.of("t", schema).encode().split(";")[0] == spec.split(";")[0]
    with pytest.raises(ValueError):
        FeatureType.parse("t", "a:Nonsense")


def test_sql_registration_and_nulls(spark):
    names = st.register(spark)
    assert len(names) >= 80
    r = spark.sql("select st_asText(st_makePoint(1, 2)) a, st_contains(st_geomFromWKT('POLYGON((0 0,0 10,10 10,10 0,0 0))'), st_point(5, 5)) b, st_x(null) c, st_distance(st_point(0,0), null) d").first()
    assert (r.a, r.b, r.c, r.d) == ("POINT (1 2)", True, None, None)


def test_bbox_reaches_the_scan(spark, tmp_path):
    p = str(tmp_path / "p")
    spark.range(100).select("id", (F.col("id") * 1.0).alias("lon"), (F.col("id") * 0.5).alias("lat")).write.parquet(p)
    df = spark.read.parquet(p)
    got = df.where(ecql("BBOX(geom, 10, 0, 20, 90)", Layout(df.schema, points={"geom": ("lon", "lat")}))).select("id")
    plan = explain(got)
    assert "PushedFilters: [IsNotNull(lon)" in plan and "GreaterThanOrEqual(lon,10.0)" in plan
    assert sorted(r.id for r in got.collect()) == list(range(10, 21))


def test_ecql_errors_and_guards(spark):
    df = spark.range(3).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    lay = Layout(df.schema)
    for bad in ("id >", "nothing = 1", "id = 1 AND", "BBOX(geom, 1"):
        with pytest.raises(Exception):
            ecql(bad, lay)
    with pytest.raises(Refused):
        run(df, Query(guards=[no_full_scan]), lay)
    with pytest.raises(Refused):
        run(df, Query("ts DURING 2024-01-01T00:00:00Z/P30D", guards=[at_most(timedelta(days=7))]), lay)
    run(df, Query("ts DURING 2024-01-01T00:00:00Z/P1D", guards=[graduated([(None, timedelta(days=7))])]), lay)


def test_visibility_labels():
    assert visible("a&b|c", {"c"}) and visible("a&(b|c)", {"a", "c"}) and not visible("a&b", {"a"}) and visible("", set())


def test_statistics_language(spark):
    df = spark.range(100).select(F.col("id").cast("int").alias("v"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("k"))
    assert aggregates.statistics(df, "Count()") == {"count": 100}
    two = aggregates.statistics(df, "MinMax(v);Enumeration(k)")
    assert (two[0]["min"], two[0]["max"], two[1]) == (0, 99, {"even": 50, "odd": 50})
    d = aggregates.statistics(df, "DescriptiveStats(v)")
    assert d["v_mean"] == 49.5 and d["v_var_pop"] == pytest.approx(833.25) and d["v_sd_samp"] == pytest.approx(29.011491)
    assert d["v_skew"] == pytest.approx(0, abs=1e-9) and d["v_kurtosis"] == pytest.approx(1.799759, abs=1e-6)
    g = aggregates.statistics(df, "GroupBy(k,Count();MinMax(v))")
    assert g["odd"][0] == {"count": 50} and g["odd"][1]["min"] == 1
    h = aggregates.statistics(df, "Histogram(v,10,20,30)")
    assert sum(h["bins"]) == 100 and h["lower-bound"] == 0
    f = aggregates.statistics(df, "Frequency(k,0.01)")
    assert aggregates.count_min_estimate(bytes.fromhex(f["sketch"]), "odd") >= 50
    assert aggregates.statistics(df.where("v < 0"), "Count()") == {"count": 0}


def test_nearest_neighbours_and_plans(spark):
    data = spark.range(50, 60).select(F.col("id").alias("key"), F.lit(45.0).alias("x"), F.col("id").cast("double").alias("y"))
    q = spark.createDataFrame([(1, 45.0, 55.0)], "q long, qx double, qy double")
    got = joins.k_nearest(q, data, ("qx", "qy"), ("x", "y"), "q", "key", 3, 1_000_000.0)
    assert sorted(r.key for r in got.collect()) == [54, 55, 56]
    assert joins.nearest_set(q, data, ("qx", "qy"), ("x", "y"), "q", "key", 20, 1_000_000.0).count() == 10
    for df in (got, joins.proximity(data, q, "key", ("x", "y"), ("qx", "qy"), 100_000.0)):
        plan = explain(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_near_join_matches_all_pairs_at_high_latitudes(spark):
    import random

    from terraflux.geom.measure import sphere_distance

    rnd = random.Random(5)
    pts = [(i, rnd.uniform(-180, 180), rnd.choice([rnd.uniform(-89.9, -80), rnd.uniform(80, 89.9), rnd.uniform(-10, 10)])) for i in range(300)]
    a = spark.createDataFrame(pts[:150], "a long, ax double, ay double")
    b = spark.createDataFrame(pts[150:], "b long, bx double, by double")
    got = {(r.a, r.b) for r in joins.within_distance(a, b, ("ax", "ay"), ("bx", "by"), 400_000.0).select("a", "b").collect()}
    want = {(p[0], q[0]) for p in pts[:150] for q in pts[150:] if sphere_distance(p[1:], q[1:]) <= 400_000}
    assert got == want and len(want) > 20


def test_salted_box_join_is_the_same(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 5.0, 5.0, 25.0, 25.0)], "b long, x0 double, y0 double, x1 double, y1 double")
    pts = spark.range(500).select("id", (F.col("id") % 30).cast("double").alias("x"), (F.col("id") % 29).cast("double").alias("y"))
    one, many = (sorted(map(tuple, joins.box_point_join(boxes, pts, ("x0", "y0", "x1", "y1"), "x", "y", size=4.0, salt=s).select("b", "id").collect())) for s in (1, 5))
    assert one == many and len(one) == len(set(one)) > 0


def test_partitions_of_points(spark):
    pts = spark.range(200).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 17).cast("double").alias("y"))
    for how in ("equal", "earth", "weighted", "rtree"):
        got = joins.grid_partition(pts, "x", "y", 9, how, sample=1.0)[0]
        assert got.count() == 200 and got.select("cell").distinct().count() >= 1
    assert joins.lookup_join(spark.createDataFrame([(1, "a"), (1, "b")], "k long, n string"), spark.createDataFrame([(1,)], "j long"), "k", "j", ["n"]).first().n == "a"


def test_sampling_over_a_half_keeps_all(spark):
    assert tracks.every_nth(spark.range(10), 0.7, ["id"]).count() == 10
    assert tracks.every_nth(spark.range(0), 0.1, ["id"]).count() == 0


def test_sampling_counts_over_many_partitions(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        df = spark.range(0, 100_000, 1, 9).withColumn("__p", F.lit(1)).withColumn("k", (F.col("id") * 7919) % 100_003)
        got = tracks.every_nth(df, 0.1, ["k"])
        assert got.columns == df.columns
        assert sorted(r.k for r in got.collect()) == sorted((i * 7919) % 100_003 for i in range(100_000))[::10]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_converter_of_delimited_text(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('ID,Name,Age,LastSeen,Friends,Talents,Lon,Lat\n23623,Harry,20,2015-05-06,"Will, Mark, Suzan","patronus->10,expelliarmus->9",-100.2,23\n26236,Hermione,25,2015-06-07,"Edward, Bill","accio->10",40.2,-53.2\nbad,,x,,,,,\n')
    c = C.Converter(
        "delimited-text",
        [("name", "$2"), ("age", "toInt($3)"), ("seen", "date('yyyy-MM-dd', emptyToNull($4))"), ("friends", "parseList('string', $5)"), ("talents", "parseMap('string->int', $6)"), ("geom", "point(toDouble($7), toDouble($8))")],
        id="$1", options={"skip-lines": "1", "format": "csv", "columns": "8"}, validators=["index"],
    )
    good, bad = C.convert(spark, c, str(f))
    rows = {r["__fid__"]: r for r in good.collect()}
    assert set(rows) == {"23623", "26236"} and bad.count() == 1
    assert rows["23623"].friends == ["Will", "Mark", "Suzan"] and rows["23623"].talents == {"patronus": 10, "expelliarmus": 9}
    assert good.select(st.st_astext("geom").alias("w")).where("w = 'POINT (-100.2 23)'").count() == 1
    c.errors = "raise-errors"
    with pytest.raises(Exception):
        C.convert(spark, c, str(f))[0].collect()


def test_converter_json_xml_fixed_and_cache(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"features":[{"id":1,"n":"x"},{"id":2,"n":"y"}]}')
    c = C.Converter("json", [("n", "jsonPath('$.n', $0)"), ("full", "cacheLookup('names', $n, 'full')")], id="jsonPath('$.id', $0)", feature_path="$.features[*]", options={"line-mode": "multi"}, caches={"names": ("k", {"x": {"full": "Xavier"}})})
    assert sorted((r["__fid__"], r.n, r.full) for r in C.convert(spark, c, str(tmp_path / "a.json"))[0].collect()) == [("1", "x", "Xavier"), ("2", "y", None)]
    (tmp_path / "a.xml").write_text("<r><f><v>1</v></f><f><v>2</v></f></r>")
    c = C.Converter("xml", [("v", "xpath('/f/v', $0)::int")], id="$v", feature_path="r/f")
    assert sorted(r.v for r in C.convert(spark, c, str(tmp_path / "a.xml"))[0].collect()) == [1, 2]
    (tmp_path / "a.txt").write_text("ab12\ncd34\n")
    c = C.Converter("fixed-width", [("s", "uppercase($1)"), ("n", "toInt($2)"), ("q", "transformListItems(list($n, 1), add($0, 1))")], id="$s", widths=[(0, 2), (2, 2)])
    assert sorted((r.s, r.n, r.q) for r in C.convert(spark, c, str(tmp_path / "a.txt"))[0].collect()) == [("AB", 12, [13.0, 2.0]), ("CD", 34, [35.0, 2.0])]


def test_composite_and_inference(spark):
    rows = spark.createDataFrame([("a,1",), ("b;2",), ("c 3",)], "v string")
    a = C.Converter("delimited-text", [("n", "regexReplace('.*,', '', $0)")], id="$0")
    b = C.Converter("delimited-text", [("n", "regexReplace('.*;', '', $0)")], id="$0")
    good, bad = C.composite(rows, [F.col("v")], [("regexReplace('[^,]', '', $0) == ','", a), ("regexReplace('[^;]', '', $0) == ';'", b)])
    assert sorted(r.n for r in good.collect()) == ["1", "2"] and bad.count() == 1
    assert C.infer([["1", "2.5", "x", "10"], ["2", "3", "", "20"]], ["id", "lat", "s", "lon"]) == [("id", "Integer"), ("lat", "Double"), ("s", "String"), ("lon", "Integer"), ("geom", "Point")]


def test_storage_round_trip(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") * 3.5 - 175).alias("lon"), (F.col("id") * 1.7 - 85).alias("lat"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("ts"))
    p = str(tmp_path / "z2")
    storage.write(df, p, "z2-4bits", lon="lon", lat="lat")
    box = (-20.0, -10.0, 40.0, 20.0)
    got = storage.read(spark, p, box=(box, 4)).where("lon between -20 and 40 and lat between -10 and 20")
    assert got.count() == df.where("lon between -20 and 40 and lat between -10 and 20").count() > 0
    d = str(tmp_path / "daily")
    storage.write(df, d, "daily", time="ts")
    assert {r.partition for r in storage.read(spark, d).select("partition").distinct().collect()} >= {"2024_01_01", "2024_01_04"}
    change = storage.read(spark, d).where("id = 5").withColumn("lon", F.lit(0.0))
    storage.update(spark, d, change, "id")
    back = storage.read(spark, d)
    assert back.count() == 100 and back.where("id = 5").first().lon == 0.0
    storage.compact(spark, d, "2024_01_01")
    assert storage.read(spark, d).count() == 100
    assert storage.metadata(spark, d, "lon", "lat").where("n > 0").count() == 5


def test_storage_changes_lose_no_rows(spark, tmp_path):
    row = "id long, ts timestamp, v string"
    day = lambda i, n, v="a": (i, datetime(2024, 1, n, 12), v)
    p = str(tmp_path / "t")
    storage.write(spark.createDataFrame([day(i, 1 + i % 3) for i in range(30)], row), p, "daily", time="ts")
    changes = lambda *rows: spark.createDataFrame(list(rows), row).withColumn("partition", F.replace(storage.partition_value("daily", time="ts"), F.lit("/"), F.lit("_")))
    state = lambda: {r.id: (r.ts.day, r.v) for r in storage.read(spark, p).collect()}
    want = {i: (1 + i % 3, "a") for i in range(30)}
    assert state() == want
    storage.update(spark, p, changes(day(100, 2, "new")), "id")  # insert into a partition that is there
    want[100] = (2, "new")
    assert state() == want
    storage.update(spark, p, changes(day(0, 3, "moved"), day(101, 9, "far")), "id")  # move, and a new partition
    want |= {0: (3, "moved"), 101: (9, "far")}
    assert state() == want
    for _ in range(2):  # again is no change
        storage.update(spark, p, changes(day(5, 3, "x")), "id")
        want[5] = (3, "x")
        assert state() == want
    storage.update(spark, p, spark.createDataFrame([(i,) for i, v in want.items() if v[0] == 1], "id long"), "id", delete=True)  # a whole partition
    want = {i: v for i, v in want.items() if v[0] != 1}
    assert state() == want and "2024_01_01" not in {r.partition for r in storage.read(spark, p).collect()}
    before = storage.read(spark, p)
    storage.compact(spark, p, file_bytes=1 << 20)
    assert state() == want and before.count() == len(want)  # a reader keeps its version
    assert storage.vacuum(spark, p) > 0 and state() == want and storage.vacuum(spark, p) == 0
    got = storage.read(spark, p, days=(datetime(2024, 1, 3), datetime(2024, 1, 9)))
    assert all("2024_01_02" not in f for f in got.inputFiles()) and {r.id for r in got.collect()} == {i for i, v in want.items() if v[0] >= 3}
    assert storage.read(spark, p, partitions=["none"]).count() == 0
    storage.update(spark, p, spark.createDataFrame([(i,) for i in want], "id long"), "id", delete=True)
    assert storage.read(spark, p).count() == 0 and storage.read(spark, p).columns == ["id", "ts", "v", "partition"]
    assert dict(spark.sparkContext.getConf().getAll()).get("spark.sql.sources.partitionOverwriteMode") is None
    with pytest.raises(FileNotFoundError):
        storage.read(spark, str(tmp_path / "none"))


def test_exports(spark):
    df = spark.createDataFrame([(1, "t", 10.0, 20.0, "2024-01-01 00:00:10")], "id long, track string, lon double, lat double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rec = export.bin_records(df, "track", "lon", "lat", "ts", "id").first().record
    assert export.read_bin(bytes(rec), True) == [(116, 1704067210, 20.0, 10.0, 1)]
    from terraflux.functions import native

    assert export.geojson(df, "id", native.point_geojson("lon", "lat"), ["track"]).first().feature == '{"type":"Feature","id":"1","geometry":{"type":"Point","coordinates":[10.0,20.0]},"properties":{"track":"t"}}'
    import pyarrow as pa

    assert pa.ipc.open_stream(export.arrow_stream(df, ["track"])).read_all().num_rows == 1
    assert export.java_hash("hello") == 99162322


def test_live_table_stream(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "id string, op string, ts timestamp, seq long, v int"
    batch = lambda rows: spark.createDataFrame(rows, "id string, op string, ts string, seq long, v int").withColumn("ts", F.col("ts").cast("timestamp"))
    batch([("a", "change", "2024-01-01", 1, 1), ("b", "change", "2024-01-01", 2, 2)]).write.mode("append").parquet(src)
    table = LiveTable(spark, str(tmp_path / "state"))
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    table.start(stream(), str(tmp_path / "cp")).awaitTermination()
    assert {r.id: r.v for r in table.query().collect()} == {"a": 1, "b": 2}
    batch([("a", "change", "2023-12-31", 3, 9), ("b", "delete", "2024-01-02", 4, 0), ("c", "change", "2024-01-02", 5, 3)]).write.mode("append").parquet(src)
    table.start(stream(), str(tmp_path / "cp")).awaitTermination()
    assert {r.id: r.v for r in table.query().collect()} == {"a": 1, "c": 3}  # an older change isn't taken
    assert table.query("v = 3").count() == 1
    cleared = batch([("a", "change", "2024-01-01", 1, 1), ("x", "clear", "2024-01-01", 2, 0), ("d", "change", "2024-01-01", 3, 4)])
    assert [r.id for r in latest_state(cleared).collect()] == ["d"]


def test_convex_hull_by_key(spark):
    df = spark.createDataFrame([(1, float(x), float(y)) for x in range(5) for y in range(5)] + [(2, 0.0, 0.0)], "k long, x double, y double").withColumn("g", st.st_makepoint("x", "y"))
    got = {r.k: r.w for r in st.convex_hull(df, "g", "k").select("k", st.st_astext("convexHull").alias("w")).collect()}
    assert got == {1: "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", 2: "POINT (0 0)"}


def test_points_in_polygons_natively(spark):
    import random

    from terraflux.functions import native
    from terraflux.geom import relate as R
    from terraflux.geom.model import from_wkt, point

    rnd = random.Random(4)
    pts = [(rnd.randint(-40, 40) / 4, rnd.randint(-40, 40) / 4) for _ in range(300)] + [(None, 1.0)]
    shapes = [
        "POLYGON ((-8 -8, 8 -8, 8 8, -8 8, -8 -8), (-4 -4, 4 -4, 4 4, -4 4, -4 -4))", "POLYGON ((0 0, 9 1, 3 9, -5 4, -2 -7, 0 0))",
        "MULTIPOLYGON (((0 0, 5 0, 5 5, 0 5, 0 0)), ((5 5, 9 5, 9 9, 5 5)))", "POLYGON ((0 0, 0 4, 4 4, 4 2, 2 2, 2 0, 0 0))",
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "i int, x double, y double")
    for wkt in shapes:
        g = from_wkt(wkt)
        at = R.Locator(g, R.tolerance(g))
        want = {i: {0: 1, 1: 0, 2: -1}[at(p)] if p[0] is not None else None for i, p in enumerate(pts)}
        got = {r.i: r.v for r in df.select("i", native.polygon_location("x", "y", [p.coords for p in g.parts()], R.tolerance(g)).alias("v")).collect()}
        assert got == want, wkt
        lay = Layout(df.schema, points={"geom": ("x", "y")})
        for op, f in (("INTERSECTS", R.intersects), ("WITHIN", R.within), ("TOUCHES", R.touches), ("DISJOINT", R.disjoint)):
            found = df.where(ecql(f"{op}(geom, {wkt})", lay))
            assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
            assert {r.i for r in found.collect()} == {i for i, p in enumerate(pts) if p[0] is not None and f(point(*p), g)}, (op, wkt)


def test_filters_beyond_the_antimeridian(spark):
    df = spark.createDataFrame([(1, 175.0, 0.0), (2, -175.0, 0.0), (3, 165.0, 0.0), (4, -165.0, 0.0), (5, 180.0, 5.0)], "i int, x double, y double")
    lay = Layout(df.schema, points={"geom": ("x", "y")})
    ids = lambda text: {r.i for r in df.where(ecql(text, lay)).collect()}
    wide, slanted = "POLYGON ((170 -10, 190 -10, 190 10, 170 10, 170 -10))", "POLYGON ((170 -10, 192 -10, 190 10, 170 10, 170 -10))"
    for shape in (wide, slanted):
        assert ids(f"INTERSECTS(geom, {shape})") == ids(f"WITHIN(geom, {shape})") == {1, 2, 5}
        assert ids(f"DISJOINT(geom, {shape})") == {3, 4}
    assert ids("DWITHIN(geom, POINT (179 0), 700, kilometers)") == {1, 2, 5}
    assert ids("DWITHIN(geom, POINT (0 89), 20000, kilometers)") == {1, 2, 3, 4, 5}


def test_curve_ranges_and_cells(spark):
    import random

    from terraflux.functions import native

    rnd = random.Random(6)
    pts = [(rnd.uniform(-180, 180), rnd.uniform(-90, 90), rnd.uniform(0, 604800)) for _ in range(2000)]
    df = spark.createDataFrame(pts, "x double, y double, t double").withColumns({"z": native.z2("x", "y", 12), "w": native.z3("x", "y", F.col("t"), 604800.0, 10)})
    cx, cy = native.z2_cell("z", 12)
    dx, dy, dt = native.z3_cell("w", 604800.0, 10)
    for r in df.select("x", "y", "t", cx.alias("cx"), cy.alias("cy"), dx.alias("dx"), dy.alias("dy"), dt.alias("dt")).collect():
        assert abs(r.x - r.cx) <= 180 / 4096 and abs(r.y - r.cy) <= 90 / 4096
        assert abs(r.x - r.dx) <= 180 / 1024 and abs(r.y - r.dy) <= 90 / 1024 and abs(r.t - r.dt) <= 302400 / 1024
    box = (-20.0, 10.0, 35.0, 50.0)
    rows = df.collect()
    stored = spark.createDataFrame(rows, df.schema)  # z as a column of a table
    inside = [r for r in rows if box[0] <= r.x <= box[2] and box[1] <= r.y <= box[3]]
    for most in (4, 50, 200):
        ranges = native.z2_ranges(box, 12, most)
        assert len(ranges) <= most + 4 and all(any(a <= r.z <= b for a, b in ranges) for r in inside)
        assert len(inside) <= stored.where(native.in_ranges("z", ranges)).count() < 2000
    ranges = native.z3_ranges(box, (1e5, 2e5), 604800.0, 10)
    assert all(any(a <= r.w <= b for a, b in ranges) for r in inside if 1e5 <= r.t <= 2e5)
    assert native.z2_ranges((-180, -90, 180, 90), 12) == [(0, 4**12 - 1)]


def test_sql_functions_reach_the_scan(spark, tmp_path):
    from terraflux.functions import sql

    spark.range(50).select(F.col("id").cast("double").alias("lon"), F.col("id").cast("double").alias("lat")).write.parquet(str(tmp_path / "p"))
    sql.register(spark)
    spark.read.parquet(str(tmp_path / "p")).createOrReplaceTempView("tf_points")
    for text, n in (("tf_in_box(lon, lat, 3, 3, 7, 9)", 5), ("tf_within(lon, lat, 10, 10, 200000)", 3)):
        df = spark.sql(f"SELECT * FROM tf_points WHERE {text}")
        assert "GreaterThanOrEqual(lat" in explain(df) and df.count() == n


def test_grouped_statistics_equal_those_of_each_group(spark):
    df = spark.createDataFrame([(k % 3, float(k), f"v{k % 2}") for k in range(60)] + [(None, 1.0, "x"), (2, None, None)], "g int, v double, s string")
    stats = "Count();MinMax(v);Enumeration(s);TopK(s);DescriptiveStats(v)"
    got = aggregates.statistics(df, f"GroupBy(g,{stats})")
    for k in range(3):
        one = aggregates.statistics(df.where(F.col("g") == k), stats)
        for a, b in zip(got[str(k)], one, strict=True):
            assert a == b or all(v == pytest.approx(b[n]) for n, v in a.items())


def test_live_table_expires_and_processes(spark, tmp_path):
    from terraflux.streaming import live

    rows = spark.createDataFrame([(k % 4, "change", datetime(2024, 1, 1 + k), k) for k in range(8)], "id int, op string, ts timestamp, seq int")
    kept: list = []
    table = LiveTable(spark, str(tmp_path / "now"), immediate=True, persist=lambda df: kept.extend(df.collect()))
    table.apply(rows, 0)
    assert table.query().count() == 0 and len(kept) == 8
    kept.clear()
    table = LiveTable(spark, str(tmp_path / "ttl"), ttl=lambda: F.lit(86_400_000 * 2).cast("long"), persist=lambda df: kept.extend(df.collect()))
    table.apply(rows, 0)
    assert {r.id for r in table.query().collect()} == {2, 3} and {r.id for r in kept} == {0, 1}
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    says, seen = iter([live.CONTINUE, live.PAUSE, live.COMMIT, *[live.COMMIT] * 9]), []

    def handler(df):
        seen.append(df.count())
        return next(says)

    live.process(stream, handler, str(tmp_path / "p"), pause_s=0.01).awaitTermination()
    n = len(spark.read.parquet(str(tmp_path / "in")).inputFiles())
    assert len(seen) == n + (1 if n > 1 else 0) and seen[-1] <= 8 and (n < 2 or seen[1] > seen[0])


def test_bounds_that_guards_see():
    from terraflux.plans.query import _bounds

    box, other = "BBOX(geom, 0, 0, 10, 10)", "BBOX(geom, 0, 0, 2, 2)"
    day, week = "dtg DURING 2024-01-01T00:00:00Z/P1D", "dtg DURING 2024-01-01T00:00:00Z/P7D"
    assert _bounds(f"{box} AND {day}") == (100.0, timedelta(days=1))
    assert _bounds(f"({box} OR {other}) AND ({day} OR {week})") == (104.0, timedelta(days=7))
    assert _bounds(f"{box} OR a = 1") == (None, None) and _bounds(f"NOT ({box})") == (None, None)
    assert _bounds(f"{box} AND {other} AND a BETWEEN 1 AND 2 AND b = ' or '") == (4.0, None)
    assert _bounds("INTERSECTS(geom, POLYGON((0 0, 4 0, 4 5, 0 0)))")[0] == 20.0


def test_audits_and_property_names(spark):
    told: list = []
    df = spark.createDataFrame([(1, 2.0, 3.0)], "fid int, x double, y double")
    run(df, Query("x = 2", limit=5, audits=[told.append]), Layout(df.schema, points={"geom": ("x", "y")}, fid="fid"))
    assert told[0]["filter"] == "x = 2" and told[0]["hints"] == {"limit": 5}
    assert aggregates.property_names("Count();MinMax(a);GroupBy(b,Histogram(c,3,0,9);MinMax(a));DescriptiveStats(d,e);Z3Histogram(g,h,week,4)") == ["a", "b", "c", "d", "e", "g", "h"]


def test_command_line(spark, tmp_path, capsys):
    import json

    from terraflux.__main__ import main

    (tmp_path / "in.csv").write_text("id,x,y,day\n" + "".join(f"{i},{i * 2},{i},2024-01-0{1 + i % 3}\n" for i in range(1, 10)) + "bad,z,1,2024-01-01\n")
    fields = [["id", "$1::long"], ["lon", "$2::double"], ["lat", "$3::double"], ["dtg", "isoDate($4)"]]
    (tmp_path / "c.json").write_text(json.dumps({"type": "delimited-text", "fields": fields, "id": "$1", "options": {"skip-lines": "1"}, "validators": ["cql: lon > 0"]}))
    table, say = str(tmp_path / "t"), lambda *a: (main(list(a), spark), capsys.readouterr())[1]
    assert say("ingest", table, str(tmp_path / "in.csv"), str(tmp_path / "c.json"), "--scheme", "daily", "--time", "dtg").err.splitlines()[-1] == "1 rows refused"
    assert "lon\tdouble" in say("describe", table).out and say("partitions", table).out.splitlines() == ["2024_01_01\t3", "2024_01_02\t3", "2024_01_03\t3"]
    assert say("count", table, "--filter", "BBOX(geom, 0, 0, 8, 90)").out == "4\n"
    assert json.loads(say("stats", table, "MinMax(id)").out)["max"] == 9
    say("delete", table, "id", "--filter", "id > 7")
    say("compact", table)
    assert say("count", table).out == "7\n" and int(say("vacuum", table).out) > 0
    say("export", table, str(tmp_path / "out"), "--format", "geojson", "--columns", "id,lon,lat", "--limit", "2")
    assert all(json.loads(r.value)["geometry"]["type"] == "Point" for r in spark.read.text(str(tmp_path / "out")).collect())
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, lon double, lat double")
    assert [list(export.records(df, f)) for f in ("values", "tuples", "dicts")] == [[1], [(1, 2.0, 3.0)], [{"id": 1, "lon": 2.0, "lat": 3.0}]]
    assert next(export.records(df, "geojson", "lon", "lat")) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [2.0, 3.0]}, "properties": {"id": 1}}


def test_shapes_are_computed_in_many_tasks_and_equal_ones_once(spark):
    from terraflux.queries import QUERIES

    assert QUERIES["st_processing"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 4
    calls = spark.sparkContext.accumulator(0)

    def counted(x, y):
        calls.add(1)
        return x + y

    st.FUNCTIONS["st_counted"] = (counted, (st.NUM, st.NUM), st.NUM)
    try:
        rows = spark.range(0, 100, 1, 1).select((F.col("id") % 5 + 1.0).alias("x"), F.when(F.col("id") % 50 != 0, F.lit(2.0)).alias("y"))
        got = rows.select(st.column_function("st_counted")("x", "y").alias("s")).collect()
    finally:
        del st.FUNCTIONS["st_counted"]
    assert [r.s for r in got] == [None if i % 50 == 0 else i % 5 + 3.0 for i in range(100)] and calls.value == 5


def _near_data(spark):
    """Points in clusters, at poles, about the antimeridian and alone; many at one place, some nowhere."""
    import random

    rnd = random.Random(3)
    some = [(rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for _ in range(60)] + [(rnd.choice([-180.0, 180.0, 179.9, -179.95]), rnd.uniform(-60, 60)) for _ in range(20)]
    some += [(rnd.uniform(-180, 180), rnd.choice([-1, 1]) * rnd.uniform(89.5, 90)) for _ in range(20)] + [(10 + rnd.gauss(0, 0.01), 50 + rnd.gauss(0, 0.01)) for _ in range(40)] + [(0.0, 90.0), (-0.0, -90.0)]
    q = [(i, *rnd.choice(some)) for i in range(150)] + [(150, None, 1.0), (151, 12.0, 50.0), (152, 100.0, -45.0)]
    d = [(i, *rnd.choice(some)) for i in range(300)] + [(300, 5.0, None), (301, None, None)]
    return q, d, spark.createDataFrame(q, "q long, qx double, qy double"), spark.createDataFrame(d, "key long, x double, y double").withColumn("i", F.lit("a name that clashes with none"))


def _near_brute(q, d, metres):
    from terraflux.geom.measure import sphere_distance

    whole = lambda r: None not in r
    return {a[0]: sorted((m, b[0]) for b in filter(whole, d) if (m := sphere_distance(a[1:], b[1:])) <= metres) for a in filter(whole, q)}


def _most_joined(df):
    """The largest count of rows that came out of a join."""

    def walk(p):
        name, kids = p.nodeName(), p.children()
        under = [p.executedPlan()] if name.startswith("Adaptive") else [p.plan()] if "QueryStage" in name else [kids.apply(i) for i in range(kids.size())]
        return max([p.metrics().apply("numOutputRows").value() if "Join" in name else 0, *map(walk, under)])

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def _copies(spark):
    """3,000 rows on each side, at 30 places that are near each other."""
    at = lambda f: (10 + F.col("id") % 30 * f).cast("double")
    rows = spark.range(3000)
    return rows.select(F.col("id").alias("q"), at(0.01).alias("qx"), at(0.011).alias("qy")), rows.select(F.col("id").alias("key"), at(0.012).alias("x"), at(0.013).alias("y"))


NEAR = (("qx", "qy"), ("x", "y"))


@pytest.mark.parametrize("k, metres", [(1, 3_000.0), (3, 900_000.0), (20, 2_500_000.0), (400, 30_000_000.0)])
def test_k_nearest_is_that_of_all_pairs(spark, k, metres):
    q, d, a, b = _near_data(spark)
    got = {}
    for r in joins.k_nearest(a, b, *NEAR, "q", "key", k, metres).select("q", "rank", "distance_m", "key").collect():
        got.setdefault(r.q, []).append((r["rank"], r.distance_m, r.key))
    want = {n: v[:k] for n, v in _near_brute(q, d, metres).items() if v}
    assert got.keys() == want.keys()
    for n, rows in got.items():
        assert [r for r, *_ in sorted(rows)] == list(range(1, len(want[n]) + 1)) and [m for _, m, _ in sorted(rows)] == pytest.approx([m for m, _ in want[n]], abs=1e-3)


def test_k_nearest_makes_no_pairs_of_copies(spark):
    q, d = _copies(spark)
    df = joins.k_nearest(q, d, *NEAR, "q", "key", 2, 500_000.0)
    assert _most_joined(df) < 100_000 and df.count() == 6000


def test_nearest_set_is_that_of_all_pairs(spark):
    q, d, a, b = _near_data(spark)
    rows = joins.nearest_set(a, b, *NEAR, "q", "key", 2, 1_500_000.0).collect()
    want = {key for v in _near_brute(q, d, 1_500_000.0).values() for _, key in v[:2]}
    assert sorted(r.key for r in rows) == sorted(want) and rows[0].i == "a name that clashes with none"
    q, d = _copies(spark)
    df = joins.nearest_set(q, d, *NEAR, "q", "key", 2, 500_000.0)
    assert _most_joined(df) < 30_000  # no pairs of copies, and no nearest rows for each of the copies


def test_proximity_is_that_of_all_pairs(spark):
    q, d, a, b = _near_data(spark)
    for metres in (0.0, 2_000.0, 700_000.0, 30_000_000.0):
        want = {key for v in _near_brute(q, d, metres).values() for _, key in v}
        assert sorted(r.key for r in joins.proximity(b, a, "key", ("x", "y"), ("qx", "qy"), metres).collect()) == sorted(want)
    q, d = _copies(spark)
    assert _most_joined(joins.proximity(d, q, "key", ("x", "y"), ("qx", "qy"), 500_000.0)) == 3000


def test_tubes_make_no_pairs(spark):
    q, d = _copies(spark)
    at = lambda df: df.withColumn("t", F.timestamp_seconds(F.lit(1_700_000_000)))
    df = joins.tube_select(at(d), at(q), "key", ("x", "y", "t"), ("qx", "qy", "t"), buffer_m=500_000.0, max_time_s=60.0)
    assert _most_joined(df) == 3000


def test_within_distance_is_that_of_all_pairs(spark):
    q, d, a, b = _near_data(spark)
    for metres in (0.0, 2_000.0, 700_000.0, 30_000_000.0):
        rows = joins.within_distance(a, b, *NEAR, metres).collect()
        want = sorted((n, key) for n, v in _near_brute(q, d, metres).items() for _, key in v)
        assert sorted((r.q, r.key) for r in rows) == want
    assert rows[0].i == "a name that clashes with none"


def test_within_distance_deals_out_different_places(spark):
    q, d = _copies(spark)
    plan = explain(joins.within_distance(q, d, *NEAR, 1000.0))
    assert plan.count("REPARTITION_BY_NUM") >= 3 and "HashAggregate" in plan


def test_customers_with_shapes_are_in_many_tasks(spark):
    from terraflux.queries import QUERIES, _cust_geom

    assert _cust_geom(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 16
    got = QUERIES["st_contains_join"](spark, "/root/testdata/sf0.001")
    assert got.groupBy(F.spark_partition_id()).count().count() > 4


def test_relations_are_computed_in_many_tasks(spark):
    from terraflux.queries import QUERIES

    df = QUERIES["st_relations"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= 16


def test_equal_arguments_with_zeros_are_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(x, y):
        calls.add(1)
        return f"{x} {y}"

    st.FUNCTIONS["st_counted"] = (counted, (st.NUM, st.NUM), st.TEXT)
    try:
        rows = spark.createDataFrame([(x, y) for x in (0.0, -0.0) for y in (0.0, -0.0)] * 25, "x double, y double").coalesce(1)
        got = rows.select(st.column_function("st_counted")("x", "y").alias("s")).collect()
    finally:
        del st.FUNCTIONS["st_counted"]
    assert [r.s for r in got] == ["0.0 0.0", "0.0 -0.0", "-0.0 0.0", "-0.0 -0.0"] * 25 and calls.value == 4


def test_converted_shapes_are_made_in_many_tasks(spark):
    from terraflux.queries import QUERIES

    df = QUERIES["convert_geometries"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= 16
