"""Registered queries over the supplied tables, each with its SQL twin where SQL can express it.

Points come from integer keys by arithmetic that is exact in any engine; measured
values are rounded, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import native
from .functions.st import column_function as st
from .operators import aggregates, joins, tracks
from .plans.ecql import Layout, mongo
from .plans.query import Query, merged, run
from .sources import convert as conv
from .sources import export, storage
from .sources.tables import events, layout, nation_boxes, points, read
from .streaming import live

FLAGSHIP = "density_grid"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _whole_ms(" ".join(sql.format(EV=_EV, CU=_pts("customer", "c_custkey"), SU=_pts("supplier", "s_suppkey"), NB=_NB, HAV=_HAV).split("\n")))
        return f

    return keep


def _whole_ms(sql: str) -> str:
    """SQL with epoch_ms(..), which rounds, as whole milliseconds."""
    at = sql.find("epoch_ms(")
    if at < 0:
        return sql
    end, depth = at + len("epoch_ms("), 1
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
    return sql[:at] + "(epoch_us(" + _whole_ms(sql[at + len("epoch_ms(") : end - 1]) + ") // 1000)" + _whole_ms(sql[end:])


def _pts(table: str, key: str) -> str:
    return f"(SELECT *, (({key} * 7919) % 36000)::DOUBLE / 100 - 180 AS lon, (({key} * 104729) % 18000)::DOUBLE / 100 - 90 AS lat FROM {table})"


_EV = _pts("events", "event_id")
_NB = "(SELECT n_nationkey, n_name, -180.0 + (n_nationkey % 5) * 72.0 AS x0, -90.0 + (n_nationkey // 5) * 36.0 AS y0, -180.0 + (n_nationkey % 5) * 72.0 + 72.0 AS x1, -90.0 + (n_nationkey // 5) * 36.0 + 36.0 AS y1 FROM nation)"
_HAV = "(2 * 6371008.7714 * asin(least(1.0, sqrt(pow(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d}) / 2), 2)))))"


def _hav(a: str, b: str, d: str) -> str:
    return _HAV.format(a=a, b=b, d=d)


def _ev(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d)


def _cust(spark: SparkSession, d: str) -> DataFrame:
    return points(read(spark, d, "customer"), "c_custkey")


def _supp(spark: SparkSession, d: str) -> DataFrame:
    return points(read(spark, d, "supplier"), "s_suppkey").withColumnsRenamed({"lon": "s_lon", "lat": "s_lat"})


def _filtered(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def go(spark: SparkSession, d: str) -> DataFrame:
        ev = _ev(spark, d)
        return run(ev, Query(text), layout(ev)).select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))

    return go


def _filter_query(name: str, text: str, where: str) -> None:
    f = _filtered(text)
    f.__name__ = name
    query("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM {EV} WHERE " + where.replace("{", "{{").replace("}", "}}"))(f)


# filters

_filter_query("filter_comparison", "value > 10 AND user_id <= 500 AND event_type <> 'view'", "value > 10 AND user_id <= 500 AND event_type <> 'view'")
_filter_query("filter_between", "value BETWEEN 5 AND 25.5", "value BETWEEN 5 AND 25.5")
_filter_query("filter_in", "event_type IN ('click', 'purchase')", "event_type IN ('click', 'purchase')")
_filter_query("filter_not_in", "NOT (user_id IN (1, 2, 3, 5, 8)) AND user_id < 30", "NOT (user_id IN (1, 2, 3, 5, 8)) AND user_id < 30")
_filter_query("filter_like", "event_type LIKE '%i%'", "event_type LIKE '%i%'")
_filter_query("filter_ilike", "event_type ILIKE 'C_IC%'", "event_type ILIKE 'C_IC%'")
_filter_query("filter_null", "value IS NOT NULL AND NOT (props IS NULL)", "value IS NOT NULL AND props IS NOT NULL")
_filter_query("filter_or", "(user_id = 7 OR user_id = 11) AND (value < 20 OR event_type = 'click')", "(user_id = 7 OR user_id = 11) AND (value < 20 OR event_type = 'click')")
_filter_query("filter_fid", "IN ('3', '14', '159')", "event_id IN (3, 14, 159)")
_filter_query("filter_bbox", "BBOX(geom, -20.5, -10, 40, 35.25)", "lon BETWEEN -20.5 AND 40 AND lat BETWEEN -10 AND 35.25")
_filter_query("filter_bbox_antimeridian", "BBOX(geom, 150, -40, 210, 40)", "(lon BETWEEN 150 AND 180 OR lon BETWEEN -180 AND -150) AND lat BETWEEN -40 AND 40")
_filter_query("filter_world", "BBOX(geom, -180, -90, 180, 90) AND user_id = 3", "user_id = 3")
_filter_query("filter_during", "ts DURING 2024-01-05T00:00:00Z/P10D", "ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15'")
_filter_query("filter_before_after", "ts BEFORE 2024-01-20T00:00:00Z AND ts AFTER 2024-01-10T12:00:00Z", "ts < TIMESTAMP '2024-01-20' AND ts > TIMESTAMP '2024-01-10 12:00:00'")
_filter_query("filter_dwithin", "DWITHIN(geom, POINT(10 20), 2500, kilometers)", _hav("20.0", "lat", "lon - 10.0") + " <= 2500000")
_filter_query("filter_json_path", "jsonPath('$.props.k') = '1' OR jsonPath('$.props.k') > '5'", "json_extract_string(props, '$.k') = '1' OR json_extract_string(props, '$.k') > '5'")
_filter_query("filter_function", "strToUpperCase(event_type) = 'CLICK' AND abs(value - 20) < 5", "upper(event_type) = 'CLICK' AND abs(value - 20) < 5")
_filter_query("filter_polygon", "INTERSECTS(geom, POLYGON((0 0, 60 0, 0 60, 0 0)))", "lon >= 0 AND lat >= 0 AND lon + lat <= 60")
_filter_query("filter_within", "WITHIN(geom, POLYGON((-50 -50, -50 50, 50 50, 50 -50, -50 -50)))", "lon > -50 AND lon < 50 AND lat > -50 AND lat < 50")
_filter_query("filter_disjoint", "DISJOINT(geom, POLYGON((-150 -80, -150 80, 150 80, 150 -80, -150 -80)))", "NOT (lon BETWEEN -150 AND 150 AND lat BETWEEN -80 AND 80)")


_filter_query("filter_before_period", "ts BEFORE 2024-01-08T00:00:00Z/P5D", "ts < TIMESTAMP '2024-01-08'")
_filter_query("filter_after_period", "ts AFTER 2024-01-08T00:00:00Z/2024-01-12T00:00:00Z", "ts > TIMESTAMP '2024-01-12'")
_filter_query("filter_before_or_during", "ts BEFORE OR DURING 2024-01-08T00:00:00Z/P5D AND NOT (ts DURING OR AFTER 2024-01-06T00:00:00Z/P1D)", "ts < TIMESTAMP '2024-01-13' AND NOT (ts > TIMESTAMP '2024-01-06')")
_filter_query("filter_any_interacts", "ts ANYINTERACTS 2024-01-08T00:00:00Z/P5D", "ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-13'")
_filter_query("filter_touches", "TOUCHES(geom, POLYGON((0 0, 60 0, 0 60, 0 0)))", "(lon = 0 AND lat BETWEEN 0 AND 60) OR (lat = 0 AND lon BETWEEN 0 AND 60) OR (lon >= 0 AND lat >= 0 AND lon + lat = 60)")
_filter_query("filter_polygon_antimeridian", "INTERSECTS(geom, POLYGON((170 -30, 200 -30, 185 30, 170 -30)))", "lat BETWEEN -30 AND 30 AND (CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) * 4 BETWEEN 170 * 4 + lat + 30 AND 200 * 4 - lat - 30")
_filter_query("filter_multipolygon", "INTERSECTS(geom, MULTIPOLYGON(((-100 -50, -50 -50, -50 0, -100 -50)), ((10 10, 90 10, 90 80, 10 80, 10 10), (30 30, 60 30, 60 60, 30 60, 30 30))))", "(lon <= -50 AND lat >= -50 AND lat <= lon + 50) OR (lon BETWEEN 10 AND 90 AND lat BETWEEN 10 AND 80 AND NOT (lon > 30 AND lon < 60 AND lat > 30 AND lat < 60))")


@query("SELECT event_id, value FROM (SELECT event_id, round(value, 6) AS value, user_id, lon, lat, event_type FROM {EV}) WHERE (user_id >= 10 AND user_id < 40 AND lon BETWEEN -90 AND 90 AND lat BETWEEN -45 AND 45) AND (event_type = 'click' OR user_id = 12)")
def filter_mongo(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    q = {"user_id": {"$gte": 10, "$lt": 40}, "geom": {"$bbox": [-90, -45, 90, 45]}, "$or": [{"event_type": "click"}, {"user_id": 12}]}
    return ev.where(mongo(q, layout(ev))).select("event_id", F.round("value", 6).alias("value"))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view')")
def filter_visibility(spark: SparkSession, d: str) -> DataFrame:
    from .plans.ecql import visibility

    ev = _ev(spark, d).withColumn("vis", F.when(F.col("event_type") == "click", "user&(admin|ops)").when(F.col("event_type") == "view", "user").otherwise("secret&user"))
    return ev.where(visibility("vis", {"user", "ops"})).select("event_id")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def age_off(spark: SparkSession, d: str) -> DataFrame:
    return tracks.age_off(_ev(spark, d), "ts", F.lit("2024-01-31").cast("timestamp"), "7 days").select("event_id")


# projection, sort, limit, sampling, views


@query("SELECT event_id::VARCHAR AS fid, user_id, upper(event_type) AS kind, round(value * 2 + 1, 6) AS twice FROM events WHERE user_id < 50")
def transforms(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    got = run(ev, Query("user_id < 50", transforms=["user_id", "kind=strToUpperCase(event_type)", "twice=value * 2 + 1"]), layout(ev))
    return got.withColumn("twice", F.round("twice", 6))


@query("SELECT event_id, round(value, 6) AS value FROM events ORDER BY value DESC, event_id LIMIT 25")
def sort_limit(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    return run(ev, Query(sort=[("value", True), ("event_id", False)], limit=25), layout(ev)).select("event_id", F.round("value", 6).alias("value"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events) WHERE k % 5 = 0")
def sampling(spark: SparkSession, d: str) -> DataFrame:
    return tracks.every_nth(_ev(spark, d), 0.2, ["event_id"]).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM events) WHERE k % 4 = 0")
def sampling_by_key(spark: SparkSession, d: str) -> DataFrame:
    return tracks.every_nth(_ev(spark, d), 0.25, ["event_id"], "event_type").select("event_id")


@query("SELECT event_id, user_id FROM events WHERE user_id < 20 UNION ALL SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def merged_view(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    return merged([(ev, "user_id < 20"), (ev, "event_type = 'click'")], layout(ev)).select("event_id", "user_id")


@query("SELECT c_custkey, round(radians(lon) * 6378137.0, 2) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 2) AS y FROM {CU} WHERE abs(lat) < 85")
def reproject_mercator(spark: SparkSession, d: str) -> DataFrame:
    x, y = native.mercator("lon", "lat")
    return _cust(spark, d).where("abs(lat) < 85").select("c_custkey", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


# density and statistics


@query("SELECT least(floor((lon + 180) * 72 / 360), 71)::INT AS i, least(floor((lat + 90) * 36 / 180), 35)::INT AS j, sum(1.0)::DOUBLE AS weight FROM {EV} WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND ts > TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-30' AND event_type = 'click' GROUP BY 1, 2")
def density_grid(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    q = Query("BBOX(geom, -180, -90, 180, 90) AND ts DURING 2024-01-02T00:00:00Z/2024-01-30T00:00:00Z AND event_type = 'click'", density=("lon", "lat", (-180.0, -90.0, 180.0, 90.0), 72, 36, None))
    return run(ev, q, layout(ev))


@query("SELECT least(floor((lon + 50) * 20 / 100), 19)::INT AS i, least(floor((lat + 25) * 10 / 50), 9)::INT AS j, round(sum(value), 4) AS weight FROM {EV} WHERE lon BETWEEN -50 AND 50 AND lat BETWEEN -25 AND 25 GROUP BY 1, 2")
def density_weighted(spark: SparkSession, d: str) -> DataFrame:
    got = aggregates.density(_ev(spark, d), "lon", "lat", (-50.0, -25.0, 50.0, 25.0), 20, 10, "value")
    return got.withColumn("weight", F.round("weight", 4))


@query("SELECT event_type, count(*) AS n, min(user_id) AS lo, max(user_id) AS hi, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stats_min_max(spark: SparkSession, d: str) -> DataFrame:
    return _ev(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("user_id").alias("lo"), F.max("user_id").alias("hi"), F.countDistinct("user_id").alias("users"))


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def stats_enumeration(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.unique(_ev(spark, d), "event_type")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def stats_top_k(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.top_k(_ev(spark, d), "user_id")


@query("SELECT event_type, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS r FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r <= 3")
def stats_top_k_by_key(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.top_k(_ev(spark, d), "user_id", 3, ["event_type"])


@query("WITH b AS (SELECT least(10.0, min(l_quantity)) AS lo, greatest(20.0, max(l_quantity)) AS hi FROM lineitem) SELECT least(floor((l_quantity - lo) * 12 / (hi - lo)), 11)::INT AS bin, count(*) AS n FROM lineitem, b GROUP BY 1")
def stats_histogram(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.histogram(read(spark, d, "lineitem"), "l_quantity", 12, 10.0, 20.0)


@query("SELECT l_returnflag, count(*) AS count, round(avg(l_quantity), 6) AS l_quantity_mean, round(var_pop(l_quantity), 4) AS l_quantity_var_pop, round(stddev_samp(l_quantity), 5) AS l_quantity_sd_samp, round(avg(l_discount), 8) AS l_discount_mean, round(covar_pop(l_quantity, l_discount), 5) AS cov, round(corr(l_quantity, l_discount), 5) AS corr FROM lineitem GROUP BY 1")
def stats_descriptive(spark: SparkSession, d: str) -> DataFrame:
    got = aggregates.descriptive(read(spark, d, "lineitem"), ["l_quantity", "l_discount"], ["l_returnflag"])
    r = lambda c, n, name=None: F.round(c, n).alias(name or c)
    return got.select("l_returnflag", "count", r("l_quantity_mean", 6), r("l_quantity_var_pop", 4), r("l_quantity_sd_samp", 5), r("l_discount_mean", 8), r("l_quantity_l_discount_cov_pop", 5, "cov"), r("l_quantity_l_discount_corr", 5, "corr"))


@query("WITH m AS (SELECT avg(l_extendedprice) AS a FROM lineitem) SELECT round(avg(pow((l_extendedprice - a) / 1000, 3)) / pow(avg(pow((l_extendedprice - a) / 1000, 2)), 1.5), 5) AS skew, round(avg(pow((l_extendedprice - a) / 1000, 4)) / pow(avg(pow((l_extendedprice - a) / 1000, 2)), 2), 5) AS kurtosis FROM lineitem, m")
def stats_moments(spark: SparkSession, d: str) -> DataFrame:
    got = aggregates.descriptive(read(spark, d, "lineitem"), ["l_extendedprice"])
    return got.select(F.round("l_extendedprice_skew", 5).alias("skew"), F.round("l_extendedprice_kurtosis", 5).alias("kurtosis"))


@query("SELECT l_shipmode_count.* FROM (SELECT l_linestatus, count(*) AS count, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max FROM lineitem GROUP BY 1) l_shipmode_count")
def stats_group_by(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.grouped_statistics(read(spark, d, "lineitem"), "l_linestatus", "Count();MinMax(l_quantity)").drop("l_quantity_cardinality")


@query("SELECT min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1, count(*) AS n FROM {EV}")
def stats_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _ev(spark, d).agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"), F.count(F.lit(1)).alias("n"))


@query("SELECT (epoch_ms(ts) // 604800000)::INT AS bin, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stats_by_time_bin(spark: SparkSession, d: str) -> DataFrame:
    b, _, _ = native.time_bin(F.col("ts"), "week")
    return _ev(spark, d).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


# spatial joins


@query("SELECT n_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM {NB} b JOIN {CU} c ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY 1")
def join_boxes_points(spark: SparkSession, d: str) -> DataFrame:
    got = joins.box_point_join(nation_boxes(spark, d), _cust(spark, d), ("x0", "y0", "x1", "y1"), "lon", "lat", size=36.0)
    return got.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {NB} a JOIN {NB} b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 WHERE a.n_nationkey < b.n_nationkey")
def join_boxes_boxes(spark: SparkSession, d: str) -> DataFrame:
    a = nation_boxes(spark, d).select(*[F.col(c).alias(f"a_{c}") for c in ("n_nationkey", "x0", "y0", "x1", "y1")])
    b = nation_boxes(spark, d).select(*[F.col(c).alias(f"b_{c}") for c in ("n_nationkey", "x0", "y0", "x1", "y1")])
    got = joins.spatial_join(a, b, tuple(f"a_{c}" for c in ("x0", "y0", "x1", "y1")), tuple(f"b_{c}" for c in ("x0", "y0", "x1", "y1")), F.col("a_n_nationkey") < F.col("b_n_nationkey"), size=50.0)
    return got.select(F.col("a_n_nationkey").alias("a"), F.col("b_n_nationkey").alias("b"))


@query("SELECT c_custkey, s_suppkey, round(" + _hav("c.lat", "s.lat", "s.lon - c.lon") + " / 1000, 3) AS km FROM {CU} c JOIN {SU} s ON " + _hav("c.lat", "s.lat", "s.lon - c.lon") + " <= 300000")
def join_within_distance(spark: SparkSession, d: str) -> DataFrame:
    got = joins.within_distance(_cust(spark, d), _supp(spark, d), ("lon", "lat"), ("s_lon", "s_lat"), 300_000.0)
    return got.select("c_custkey", "s_suppkey", F.round(F.col("distance_m") / 1000, 3).alias("km"))


@query("SELECT c_custkey, s_suppkey, rank FROM (SELECT c_custkey, s_suppkey, (row_number() OVER (PARTITION BY c_custkey ORDER BY m, s_suppkey))::INT AS rank FROM (SELECT c_custkey, s_suppkey, " + _hav("c.lat", "s.lat", "s.lon - c.lon") + " AS m FROM {CU} c JOIN {SU} s ON true) WHERE m <= 2000000) WHERE rank <= 3")
def join_k_nearest(spark: SparkSession, d: str) -> DataFrame:
    got = joins.k_nearest(_cust(spark, d), _supp(spark, d), ("lon", "lat"), ("s_lon", "s_lat"), "c_custkey", "s_suppkey", 3, 2_000_000.0)
    return got.select("c_custkey", "s_suppkey", "rank")


@query("SELECT c_custkey FROM {CU} c WHERE EXISTS (SELECT 1 FROM {SU} s WHERE " + _hav("c.lat", "s.lat", "s.lon - c.lon") + " <= 500000)")
def proximity(spark: SparkSession, d: str) -> DataFrame:
    return joins.proximity(_cust(spark, d), _supp(spark, d), "c_custkey", ("lon", "lat"), ("s_lon", "s_lat"), 500_000.0).select("c_custkey")


@query("SELECT event_id FROM {EV} e WHERE EXISTS (SELECT 1 FROM {EV} t WHERE t.user_id = 7 AND " + _hav("e.lat", "t.lat", "t.lon - e.lon") + " <= 1000000 AND abs(epoch_ms(e.ts) - epoch_ms(t.ts)) < 86400000)")
def tube_select(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    return joins.tube_select(ev, ev.where("user_id = 7"), "event_id", ("lon", "lat", "ts"), ("lon", "lat", "ts"), buffer_m=1_000_000.0, max_time_s=86_400.0).select("event_id")


@query()
def tube_select_interpolated(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    return joins.tube_select(ev, ev.where("user_id = 7"), "event_id", ("lon", "lat", "ts"), ("lon", "lat", "ts"), buffer_m=500_000.0, max_time_s=43_200.0, gap_fill="line", step_s=14_400.0).select("event_id")


@query()
def route_search(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d).withColumn("heading", (F.col("user_id") * 37 % 360).cast("double"))
    return joins.route_search(ev, [(-60.0, 10.0), (0.0, 20.0), (50.0, -10.0)], "lon", "lat", "heading", buffer_m=800_000.0, threshold=60.0, bidirectional=True).select("event_id")


@query("SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_totalprice > 100000").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joins.lookup_join(read(spark, d, "nation"), o, "n_nationkey", "c_nationkey", ["n_name"]).select("o_orderkey", "n_name")


@query("SELECT e.event_id, p.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d).select("event_id", "user_id", "event_type", "ts")
    a, b = ev.where("event_type = 'click'").drop("event_type"), ev.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return joins.as_of_join(a, b, "user_id", "ts", "ts", ["last_purchase"], tie="last_purchase").select("event_id", "last_purchase")


@query("SELECT a.event_id, b.event_id AS near_id FROM events a JOIN events b ON a.user_id = b.user_id AND epoch_ms(a.ts) BETWEEN epoch_ms(b.ts) AND epoch_ms(b.ts) + 7200000 WHERE a.event_type = 'click' AND b.event_type = 'view'")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d).select("event_id", "user_id", "event_type", F.unix_millis("ts").alias("t"))
    a = ev.where("event_type = 'click'").drop("event_type")
    b = ev.where("event_type = 'view'").select(F.col("event_id").alias("near_id"), F.col("user_id").alias("user_id"), F.col("t").alias("t0"), (F.col("t") + 7_200_000).alias("t1"))
    return joins.interval_join(a, b, "t", "t0", "t1", 7_200_000.0, key="user_id").select("event_id", "near_id")


@query("SELECT least(floor((lon + 180) * 4 / 360), 3)::INT * 4 + least(floor((lat + 90) * 4 / 180), 3)::INT AS cell, count(*) AS n FROM {CU} GROUP BY 1")
def grid_partition_earth(spark: SparkSession, d: str) -> DataFrame:
    return joins.grid_partition(_cust(spark, d), "lon", "lat", 16, "earth")[0].groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query("WITH p AS (SELECT * FROM {CU}), b AS (SELECT min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM p) SELECT least(floor((lon - x0) * 3 / (x1 - x0)), 2)::INT * 3 + least(floor((lat - y0) * 3 / (y1 - y0)), 2)::INT AS cell, count(*) AS n FROM p, b GROUP BY 1")
def grid_partition_equal(spark: SparkSession, d: str) -> DataFrame:
    return joins.grid_partition(_cust(spark, d), "lon", "lat", 9, "equal")[0].groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


# tracks

_SEG = "SELECT user_id AS track, epoch_ms(ts) AS t0, round(lon, 4) AS x0, epoch_ms(t1) AS t1, round(x1, 4) AS x1 FROM (SELECT *, lead(ts) OVER w AS t1, lead(lon) OVER w AS x1, lead(lat) OVER w AS y1, count(*) OVER (PARTITION BY user_id) AS n FROM {EV} WINDOW w AS (PARTITION BY user_id%s ORDER BY ts, event_id)) WHERE t1 IS NOT NULL AND n > 2 AND (lon <> x1 OR lat <> y1)"


def _segments(spark: SparkSession, d: str, by_day: bool) -> DataFrame:
    got = tracks.segments(_ev(spark, d), "user_id", "ts", "lon", "lat", "event_id", break_on_day=by_day)
    return got.select("track", F.unix_millis("start_time").alias("t0"), F.round("start_lon", 4).alias("x0"), F.unix_millis("end_time").alias("t1"), F.round("end_lon", 4).alias("x1"))


@query(_SEG % "")
def track_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d, False)


@query(_SEG % ", ts::DATE")
def track_segments_by_day(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d, True)


@query("SELECT event_id, round(" + _hav("py", "lat", "lon - px") + " / 1000, 3) AS km FROM (SELECT *, lag(lon) OVER w AS px, lag(lat) OVER w AS py FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def track_distance(spark: SparkSession, d: str) -> DataFrame:
    return tracks.with_distance(_ev(spark, d), "user_id", "ts", "lon", "lat", "event_id").select("event_id", F.round(F.col("step_m") / 1000, 3).alias("km"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def track_latest(spark: SparkSession, d: str) -> DataFrame:
    return tracks.latest(_ev(spark, d), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("SELECT event_id, epoch_ms(ts + INTERVAL 1 DAY + INTERVAL 2 HOUR) AS moved FROM events")
def date_offset(spark: SparkSession, d: str) -> DataFrame:
    return tracks.date_offset(_ev(spark, d), "ts", "P1DT2H").select("event_id", F.unix_millis("ts").alias("moved"))


# curves, geohashes, time bins

_Z2 = "(list_sum(list_transform(range(0, 16), lambda b: (((x >> b) & 1) << (2 * b)) | (((y >> b) & 1) << (2 * b + 1)))))::BIGINT"


@query("SELECT c_custkey, " + _Z2 + " AS z FROM (SELECT c_custkey, least(floor((lon + 180) * 65536 / 360), 65535)::BIGINT AS x, least(floor((lat + 90) * 65536 / 180), 65535)::BIGINT AS y FROM {CU})")
def curve_z2(spark: SparkSession, d: str) -> DataFrame:
    return _cust(spark, d).select("c_custkey", native.z2("lon", "lat", 16).alias("z"))


@query("SELECT event_id, (epoch_ms(ts) // 604800000)::INT AS bin, (list_sum(list_transform(range(0, 21), lambda b: (((x >> b) & 1) << (3 * b)) | (((y >> b) & 1) << (3 * b + 1)) | (((t >> b) & 1) << (3 * b + 2)))))::BIGINT AS z FROM (SELECT event_id, ts, least(floor((lon + 180) * 2097152 / 360), 2097151)::BIGINT AS x, least(floor((lat + 90) * 2097152 / 180), 2097151)::BIGINT AS y, least(floor((epoch_ms(ts) // 1000 - epoch_ms(ts) // 604800000 * 604800) * 2097152.0 / 604800), 2097151)::BIGINT AS t FROM {EV})")
def curve_z3(spark: SparkSession, d: str) -> DataFrame:
    b, off, whole = native.time_bin(F.col("ts"), "week")
    return _ev(spark, d).select("event_id", b.alias("bin"), native.z3("lon", "lat", off, whole).alias("z"))


@query("SELECT event_id, date_diff('day', DATE '1970-01-01', ts::DATE)::INT AS day, ((year(ts) - 1970) * 12 + month(ts) - 1)::INT AS month, (year(ts) - 1970)::INT AS year, (epoch_ms(ts) - epoch_ms(date_trunc('day', ts)::TIMESTAMP))::BIGINT AS day_ms FROM events")
def time_bins(spark: SparkSession, d: str) -> DataFrame:
    day, off, _ = native.time_bin(F.col("ts"), "day")
    return _ev(spark, d).select("event_id", day.alias("day"), native.time_bin(F.col("ts"), "month")[0].cast("int").alias("month"), native.time_bin(F.col("ts"), "year")[0].cast("int").alias("year"), off.alias("day_ms"))


@query("SELECT c_custkey, list_aggregate(list_transform(range(0, 5), lambda c: substr('0123456789bcdefghjkmnpqrstuvwxyz', (list_sum(list_transform(range(0, 5), lambda k: (CASE WHEN (5 * c + k) % 2 = 0 THEN (x >> (12 - (5 * c + k) // 2)) & 1 ELSE (y >> (11 - (5 * c + k) // 2)) & 1 END) << (4 - k))) + 1)::BIGINT, 1)), 'string_agg', '') AS hash FROM (SELECT c_custkey, least(floor((lon + 180) * 8192 / 360), 8191)::BIGINT AS x, least(floor((lat + 90) * 4096 / 180), 4095)::BIGINT AS y FROM {CU})")
def geohash(spark: SparkSession, d: str) -> DataFrame:
    return _cust(spark, d).select("c_custkey", native.geohash("lon", "lat", 25).alias("hash"))


# st_* functions


def _cust_geom(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a geometry, in many tasks, since shapes are much work."""
    return joins.spread(_cust(spark, d)).withColumn("geom", st("st_makepoint")("lon", "lat"))


@query("SELECT c_custkey, n_nationkey FROM {CU} c JOIN {NB} b ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1")
def st_contains_join(spark: SparkSession, d: str) -> DataFrame:
    boxes = nation_boxes(spark, d).withColumn("box", st("st_makebbox")("x0", "y0", "x1", "y1"))
    got = joins.box_point_join(boxes, _cust_geom(spark, d), ("x0", "y0", "x1", "y1"), "lon", "lat", size=36.0)
    return got.where(st("st_contains")("box", "geom")).select("c_custkey", "n_nationkey")


@query("SELECT n_nationkey, 2592.0::DOUBLE AS area, 216.0::DOUBLE AS length, (x0 + 36)::DOUBLE AS cx, (y0 + 18)::DOUBLE AS cy, 'Polygon' AS kind FROM {NB}")
def st_measures(spark: SparkSession, d: str) -> DataFrame:
    b = nation_boxes(spark, d).withColumn("box", st("st_makebbox")("x0", "y0", "x1", "y1"))
    c = b.withColumn("c", st("st_centroid")("box"))
    return c.select("n_nationkey", st("st_area")("box").alias("area"), st("st_length")("box").alias("length"), F.round(st("st_xd")("c"), 6).alias("cx"), F.round(st("st_yd")("c"), 6).alias("cy"), st("st_geometrytype")("box").alias("kind"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, (a.n_nationkey <> b.n_nationkey) AS touches FROM {NB} a JOIN {NB} b ON a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def st_touches_join(spark: SparkSession, d: str) -> DataFrame:
    b = nation_boxes(spark, d).withColumn("box", st("st_makebbox")("x0", "y0", "x1", "y1"))
    cols = ("n_nationkey", "x0", "y0", "x1", "y1", "box")
    left, right = (b.select(*[F.col(c).alias(f"{p}_{c}") for c in cols]) for p in "ab")
    got = joins.spatial_join(left, right, tuple(f"a_{c}" for c in cols[1:5]), tuple(f"b_{c}" for c in cols[1:5]), F.lit(True), size=72.0)
    return got.select(F.col("a_n_nationkey").alias("a"), F.col("b_n_nationkey").alias("b"), st("st_touches")("a_box", "b_box").alias("touches"))


@query("SELECT c_custkey, round(sqrt(lon * lon + lat * lat), 6) AS planar, round(" + _hav("lat", "0.0", "0.0 - lon") + " / 1000, 3) AS km FROM {CU}")
def st_distances(spark: SparkSession, d: str) -> DataFrame:
    from .geom.model import point

    g = _cust_geom(spark, d).withColumn("o", F.lit(export_wkb(point(0, 0))))
    return g.select("c_custkey", F.round(st("st_distance")("geom", "o"), 6).alias("planar"), F.round(st("st_distancesphere")("geom", "o") / 1000, 3).alias("km"))


def export_wkb(g) -> bytes:
    from .geom.model import to_wkb

    return to_wkb(g)


@query()
def st_spheroid(spark: SparkSession, d: str) -> DataFrame:
    from .geom.model import point

    return _cust_geom(spark, d).select("c_custkey", F.round(st("st_distancespheroid")("geom", F.lit(export_wkb(point(0, 0)))) / 1000, 3).alias("km"))


@query()
def st_convex_hull(spark: SparkSession, d: str) -> DataFrame:
    from .functions.st import convex_hull

    return convex_hull(_cust_geom(spark, d), "geom", "c_nationkey").select("c_nationkey", st("st_numpoints")("convexHull").alias("corners"), F.round(st("st_area")("convexHull"), 4).alias("area"))


@query("SELECT c_custkey, 'POINT (' || CASE WHEN lon = floor(lon) THEN lon::BIGINT::VARCHAR ELSE round(lon, 2)::VARCHAR END || ' ' || CASE WHEN lat = floor(lat) THEN lat::BIGINT::VARCHAR ELSE round(lat, 2)::VARCHAR END || ')' AS wkt FROM (SELECT c_custkey, round(lon, 2) AS lon, round(lat, 2) AS lat FROM {CU})")
def st_as_text(spark: SparkSession, d: str) -> DataFrame:
    return joins.spread(_cust(spark, d)).select("c_custkey", st("st_astext")(st("st_makepoint")(F.round("lon", 2), F.round("lat", 2))).alias("wkt"))


# converter functions


def _converted(spark: SparkSession, d: str, name: str, fields: list[tuple[str, str]], names: list[str]) -> DataFrame:
    df = read(spark, d, name)
    good, _ = conv.convert_rows(df, [F.to_json(F.struct(*df.columns)), *[F.col(c) for c in df.columns]], {c: F.col(c) for c in df.columns}, conv.Converter("parquet", fields, id=f"toString(${names[0]})"))
    return good.select(*names)


@query("SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, replace(c_name, '#', '-') AS re, substr(c_name, 1, 8) AS sub, length(c_name)::INT AS len, c_name || ':' || c_custkey::VARCHAR AS cat, upper(substr(lower(c_mktsegment), 1, 1)) || substr(lower(c_mktsegment), 2) AS cap FROM customer")
def convert_strings(spark: SparkSession, d: str) -> DataFrame:
    f = [("c_custkey", "$c_custkey"), ("low", "lowercase($c_name)"), ("up", "uppercase($c_mktsegment)"), ("re", "replace($c_name, '#', '-')"), ("sub", "substr($c_name, 0, 8)"), ("len", "strlen($c_name)"), ("cat", "mkstring(':', $c_name, $c_custkey)"), ("cap", "capitalize(lowercase($c_mktsegment))")]
    return _converted(spark, d, "customer", f, [n for n, _ in f])


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, epoch_ms(o_orderdate) AS ms, round(o_totalprice / 2 + 1, 4) AS half, CASE WHEN o_orderstatus = 'X' THEN 1 ELSE -1 END::INT AS num FROM orders")
def convert_dates_numbers(spark: SparkSession, d: str) -> DataFrame:
    f = [("o_orderkey", "$o_orderkey"), ("day", "dateToString('yyyy-MM-dd', $o_orderdate)"), ("ms", "dateToMillis($o_orderdate)"), ("half", "add(divide($o_totalprice, 2), 1)"), ("num", "try(toInt($o_orderstatus), -1)")]
    return _converted(spark, d, "orders", f, [n for n, _ in f]).withColumn("half", F.round("half", 4))


@query("SELECT p_partkey, string_split(p_type, ' ')[1] AS first, len(string_split(p_type, ' '))::INT AS n, coalesce(p_brand, '-') AS brand, md5(p_name) AS hash FROM part")
def convert_lists(spark: SparkSession, d: str) -> DataFrame:
    f = [("p_partkey", "$p_partkey"), ("parts", "parseList('string', $p_type, ' ')"), ("first", "listItem($parts, 0)"), ("brand", "withDefault($p_brand, '-')"), ("hash", "md5(stringToBytes($p_name))")]
    return _converted(spark, d, "part", f, ["p_partkey", "first", "parts", "brand", "hash"]).select("p_partkey", "first", F.size("parts").alias("n"), "brand", "hash")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def convert_json(spark: SparkSession, d: str) -> DataFrame:
    f = [("event_id", "$event_id"), ("k", "jsonPath('$.k', $props)")]
    return _converted(spark, d, "events", f, ["event_id", "k"]).where("k is not null")


# storage and export


@query("SELECT strftime(ts, '%Y/%m/%d') AS day, count(*) AS n FROM events GROUP BY 1")
def storage_daily(spark: SparkSession, d: str) -> DataFrame:
    return _ev(spark, d).groupBy(storage.partition_value("daily", time="ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(ts, '%Y/%m') || '/' || event_type AS part, count(*) AS n FROM events GROUP BY 1")
def storage_composite(spark: SparkSession, d: str) -> DataFrame:
    return _ev(spark, d).groupBy(storage.partition_value("monthly,attribute:event_type", time="ts").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query()
def export_bin(spark: SparkSession, d: str) -> DataFrame:
    return export.bin_records(_ev(spark, d), "user_id", "lon", "lat", "ts").select(F.hex("record").alias("record"))


@query()
def export_geojson(spark: SparkSession, d: str) -> DataFrame:
    return export.geojson(_ev(spark, d), "event_id", native.point_geojson("lon", "lat"), ["user_id", "event_type"])


# live views


def _messages(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    op = F.when(F.col("event_id") % 1500 == 700, "clear").when(F.col("event_id") % 11 == 0, "delete").otherwise("change")
    return ev.select(F.col("user_id").alias("id"), op.alias("op"), "ts", F.col("event_id").alias("seq"), F.round("value", 6).alias("value"))


_MSG = "(SELECT user_id AS id, CASE WHEN event_id % 1500 = 700 THEN 'clear' WHEN event_id % 11 = 0 THEN 'delete' ELSE 'change' END AS op, ts, event_id AS seq, round(value, 6) AS value FROM events)"


@query("WITH m AS (SELECT * FROM " + _MSG + "), c AS (SELECT coalesce(max(seq), -1) AS c FROM m WHERE op = 'clear'), g AS (SELECT id, max(seq) AS g FROM m WHERE op = 'delete' GROUP BY 1) SELECT id, seq, value FROM (SELECT m.*, row_number() OVER (PARTITION BY m.id ORDER BY ts DESC, seq DESC) AS r FROM m JOIN c ON true LEFT JOIN g ON m.id = g.id WHERE op = 'change' AND seq > c AND (g IS NULL OR seq > g)) WHERE r = 1")
def live_latest(spark: SparkSession, d: str) -> DataFrame:
    return live.latest_state(_messages(spark, d)).select("id", "seq", "value")


@query("SELECT user_id AS id, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND (CASE WHEN event_type = 'click' THEN epoch_ms(ts) + 432000000 WHEN value > 20 THEN epoch_ms(ts) + 864000000 ELSE NULL END > epoch_ms(TIMESTAMP '2024-01-30') OR NOT (event_type = 'click' OR value > 20))")
def live_filtered_expiry(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d).select(F.col("user_id").alias("id"), F.lit("change").alias("op"), "ts", F.col("event_id").alias("seq"), "event_type", "value")
    ttl = live.filtered_ttl([("event_type = 'click'", 432_000_000), ("value > 20", 864_000_000), ("INCLUDE", None)], Layout(ev.schema))
    return live.latest_state(ev, now=F.lit("2024-01-30").cast("timestamp"), ttl=ttl).select("id", "seq")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, (event_id % 2 = 0)::INT DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def hot_cold_merge(spark: SparkSession, d: str) -> DataFrame:
    ev = _ev(spark, d)
    return live.merged_latest(ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("SELECT epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS start_ms, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return live.windowed_counts(_ev(spark, d), "ts", "event_type", "1 day", "1 hour").select(F.unix_millis("start").alias("start_ms"), "event_type", "n")


@query("SELECT user_id, epoch_ms(min(ts)) AS start_ms, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def window_sessions(spark: SparkSession, d: str) -> DataFrame:
    return live.sessions(_ev(spark, d), "ts", "user_id", "6 hours").select("user_id", F.unix_millis("start").alias("start_ms"), "n")


# plain relational coverage


def _relational(name: str, sql: str, make: Callable[[SparkSession, str], DataFrame]) -> None:
    make.__name__ = name
    query(sql)(make)


def _li(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "lineitem")


_relational("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1", lambda s, d: read(s, d, "customer").join(read(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")))
_relational("join_full", "SELECT count(*) AS n, count(c_custkey) AS c, count(o_orderkey) AS o FROM customer FULL JOIN orders ON c_custkey = o_custkey", lambda s, d: read(s, d, "customer").join(read(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "full").agg(F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("c"), F.count("o_orderkey").alias("o")))
_relational("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", lambda s, d: read(s, d, "customer").join(read(s, d, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"))
_relational("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", lambda s, d: read(s, d, "customer").join(read(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"))
_relational("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", lambda s, d: _li(s, d).rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q")))
_relational("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", lambda s, d: _li(s, d).cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")))
_relational("agg_pivot", "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN 1 END)::BIGINT AS o, sum(CASE WHEN l_linestatus = 'F' THEN 1 END)::BIGINT AS f FROM lineitem GROUP BY 1", lambda s, d: _li(s, d).groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count().withColumnsRenamed({"O": "o", "F": "f"}))
_relational("agg_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1", lambda s, d: read(s, d, "orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers")))
_relational("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", lambda s, d: read(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(read(s, d, "supplier").select("s_nationkey")).distinct())
_relational("set_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders", lambda s, d: read(s, d, "customer").select(F.col("c_custkey").alias("k")).intersect(read(s, d, "orders").select("o_custkey")))
_relational("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", lambda s, d: read(s, d, "customer").select(F.col("c_custkey").alias("k")).subtract(read(s, d, "orders").select("o_custkey")))


def _w(desc: bool = False) -> Window:
    return Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc() if desc else F.col("o_totalprice"), "o_orderkey")


_relational(
    "window_functions",
    "SELECT o_orderkey, (row_number() OVER w)::INT AS rn, (rank() OVER w)::INT AS rk, (ntile(3) OVER w)::INT AS nt, lag(o_orderkey) OVER w AS before, first_value(o_orderkey) OVER w AS first, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)",
    lambda s, d: read(s, d, "orders").select("o_orderkey", F.row_number().over(_w()).alias("rn"), F.rank().over(_w()).alias("rk"), F.ntile(3).over(_w()).alias("nt"), F.lag("o_orderkey").over(_w()).alias("before"), F.first("o_orderkey").over(_w()).alias("first"), F.round(F.sum("o_totalprice").over(_w().rowsBetween(-1, 0)), 2).alias("moving")),
)

from . import function_queries, source_queries  # noqa: E402, F401  register their queries here
