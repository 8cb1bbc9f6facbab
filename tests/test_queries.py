"""Every registered query that has an SQL twin, against DuckDB."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from terraflux.queries import ORACLES, QUERIES

DATA = os.environ.get("TERRAFLUX_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    want = sorted(tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


def events_and(duck, more=""):
    return duck.sql(f"select event_id, user_id, epoch_us(ts) / 1e6 as t, ((event_id * 7919) % 36000)::double / 100 - 180 as lon, ((event_id * 104729) % 18000)::double / 100 - 90 as lat {more} from events").fetchall()


def sphere(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371008.7714 * math.asin(min(1.0, math.sqrt(h)))


def brute_tube(spark, duck):
    rows = events_and(duck)
    track = sorted((t, x, y) for _, u, t, x, y in rows if u == 7)
    pts = []
    for (t0, x0, y0), (t1, x1, y1) in zip(track, track[1:]):
        n = max(1, math.ceil((math.floor(t1 * 1000) - math.floor(t0 * 1000)) / 14_400_000))
        pts += [(t0 + (t1 - t0) * k / n, x0 + (x1 - x0) * k / n, y0 + (y1 - y0) * k / n) for k in range(n)]
    pts += track[-1:]
    return {(e,) for e, _, t, x, y in rows if any(abs(t - p[0]) < 43_200 and sphere((x, y), p[1:]) <= 500_000 for p in pts)}


def brute_route(spark, duck):
    route, out = [(-60.0, 10.0), (0.0, 20.0), (50.0, -10.0)], set()
    for e, u, _, x, y in events_and(duck):
        best = None
        for a, b in zip(route, route[1:]):
            k = math.cos(math.radians(y))
            ax, ay, dx, dy = (a[0] - x) * k, a[1] - y, (b[0] - a[0]) * k, b[1] - a[1]
            s = max(0.0, min(1.0, -(ax * dx + ay * dy) / max(dx * dx + dy * dy, 1e-30)))
            la, lb, d = math.radians(a[1]), math.radians(b[1]), math.radians(b[0] - a[0])
            head = math.degrees(math.atan2(math.sin(d) * math.cos(lb), math.cos(la) * math.sin(lb) - math.sin(la) * math.cos(lb) * math.cos(d))) % 360
            got = (math.radians(math.hypot(ax + s * dx, ay + s * dy)) * 6371008.7714, head)
            best = got if best is None or got < best else best
        turn = abs(u * 37 % 360 - best[1]) % 360
        turn = min(turn, 360 - turn)
        if best[0] <= 800_000 and (turn <= 60 or 180 - turn <= 60):
            out.add((e,))
    return out


def brute_spheroid(spark, duck):
    """Vincenty's inverse formula."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    out = set()
    for k, x, y in duck.sql("select c_custkey, ((c_custkey * 7919) % 36000)::double / 100 - 180, ((c_custkey * 104729) % 18000)::double / 100 - 90 from customer").fetchall():
        u1, u2, lam, L = 0.0, math.atan((1 - f) * math.tan(math.radians(y))), math.radians(x), math.radians(x)
        for _ in range(2000):
            s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
            c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
            sigma = math.atan2(s, c)
            sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / s if s else 0.0
            cos2 = 1 - sin_a**2
            m = c - 2 * math.sin(u1) * math.sin(u2) / cos2 if cos2 else 0.0
            C = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = L + (1 - C) * f * sin_a * (sigma + C * s * (m + C * c * (2 * m * m - 1)))
            if abs(new - lam) < 1e-13:
                break
            lam = new
        else:
            out.add((k, None))  # nearly opposite points: it does not settle
            continue
        v = cos2 * (a * a - b * b) / (b * b)
        A, B = 1 + v / 16384 * (4096 + v * (v * (320 - 175 * v) - 768)), v / 1024 * (256 + v * (v * (74 - 47 * v) - 128))
        ds = B * s * (m + B / 4 * (c * (2 * m * m - 1) - B / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))
        out.add((k, round(b * A * (sigma - ds) / 1000, 3)))
    return out


def brute_hull(spark, duck):
    groups: dict = {}
    for n, x, y in duck.sql("select c_nationkey, ((c_custkey * 7919) % 36000)::double / 100 - 180, ((c_custkey * 104729) % 18000)::double / 100 - 90 from customer").fetchall():
        groups.setdefault(n, set()).add((x, y))
    out = set()
    for n, pts in groups.items():
        hull = [min(pts)]
        while len(pts) > 2:  # gift wrapping
            nxt = None
            for p in pts - {hull[-1]}:
                c = 0 if nxt is None else (nxt[0] - hull[-1][0]) * (p[1] - hull[-1][1]) - (nxt[1] - hull[-1][1]) * (p[0] - hull[-1][0])
                if nxt is None or c < 0 or (c == 0 and math.dist(p, hull[-1]) > math.dist(nxt, hull[-1])):
                    nxt = p
            if nxt == hull[0]:
                break
            hull.append(nxt)
        ring = [*hull, hull[0]]
        out.add((n, round(abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:]))) / 2, 3)))
    return out


def test_queries_without_sql(spark, duck):
    got = lambda name, *cols: {tuple(r[c] for c in cols) for r in QUERIES[name](spark, DATA).collect()}
    assert got("tube_select_interpolated", "event_id") == brute_tube(spark, duck) != set()
    assert got("route_search", "event_id") == brute_route(spark, duck) != set()
    want = dict(brute_spheroid(spark, duck))
    assert all(want[k] is None or abs(want[k] - km) < 0.002 for k, km in got("st_spheroid", "c_custkey", "km")) and len(want) > 100
    want = dict(brute_hull(spark, duck))
    assert all(abs(want[n] - area) < 0.01 for n, area in got("st_convex_hull", "c_nationkey", "area") if n in want) and len(want) > 20
    n = duck.sql("select count(*) from events").fetchall()[0][0]
    assert QUERIES["export_bin"](spark, DATA).count() == QUERIES["export_geojson"](spark, DATA).count() == n
    assert {len(r.record) for r in QUERIES["export_bin"](spark, DATA).collect()} == {32}
    tested = {"tube_select_interpolated", "route_search", "st_spheroid", "st_convex_hull", "export_bin", "export_geojson"}
    assert set(QUERIES) - set(ORACLES) == tested


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
