"""The point-cloud operators on analytic fixtures, against numpy, sqlite and a plain heap."""

import heapq
import json
import math
import os
import sqlite3
import struct

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lidarspark.functions import radio, utm
from lidarspark.operators import density, coverage, paths, spatial, summaries, terrain
from lidarspark.operators.cuts import cut
from lidarspark.operators.spatial import Box
from lidarspark.plans import registry
from lidarspark.schema import ANTENNAS, POINTS, PROCESSED, default_antennas
from lidarspark.session import Survey
from lidarspark.sources import las, snapshots, sql, tables
from lidarspark.streaming import changes, tiles

SF = "/root/testdata/sf0.001"
P = "id long, easting double, northing double, altitude double"


def points(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], P)


def metrics(spark, rows, radius=5.0):
    return {r.id: r for r in terrain.terrain_metrics(points(spark, rows), radius).collect()}


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if v is None or v != v else float(v) if isinstance(v, (float, np.floating)) else v for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name[:-8]} as select * from read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op")))
def test_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k not in entry.oracle_sql() and not k.startswith(("op", "pipeline"))))
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_planes(spark):
    flat = metrics(spark, [(x, y, 100) for x in range(5) for y in range(5)])[12]
    assert (flat.slope, flat.rough, flat.curvature, flat.normal_z, flat.trav_score) == pytest.approx((0, 0, 0, 1, 1))
    tilted = metrics(spark, [(x, y, 0.2 * x) for x in range(5) for y in range(5)])[12]
    assert (tilted.slope, tilted.rough, tilted.curvature) == pytest.approx((11.309932, 0, 0), abs=1e-6)
    line = metrics(spark, [(x, 2 * x, 0.3 * x) for x in range(6)], 50.0)[0]
    assert line.slope == pytest.approx(7.641405, abs=1e-5)
    same = metrics(spark, [(1, 1, 1)] * 3)[0]
    assert same.n == 3 and same.slope == 0 and same.curvature is None and same.trav_score == 0
    assert metrics(spark, [(0, 0, 0), (1, 1, 1), (90, 90, 0)]) == {}


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(0)
    xyz = np.column_stack([519312 + rng.random(400) * 6, 4252965 + rng.random(400) * 6, 1300 + rng.random(400)])
    got = metrics(spark, xyz.tolist(), 2.0)
    for i in range(0, 400, 37):
        near = xyz[(abs(xyz[:, 0] - xyz[i, 0]) <= 2) & (abs(xyz[:, 1] - xyz[i, 1]) <= 2)]
        d = near - near.mean(axis=0)
        (a, b), *_ = np.linalg.lstsq(d[:, :2], d[:, 2], rcond=None)
        w = np.linalg.eigvalsh(d.T @ d)
        want = (math.degrees(math.atan(math.hypot(a, b))), math.sqrt(((d[:, 2] - d[:, :2] @ [a, b]) ** 2).mean()), w[0] / w.sum())
        assert (got[i].slope, got[i].rough, got[i].curvature) == pytest.approx(want, abs=1e-7) and got[i].n == len(near)


def test_square_edges_and_circle(spark):
    rows = points(spark, [(0, 0, 0), (5, 0, 0), (4.5, 4.5, 0), (5.01, 0, 0)])
    count = lambda circle: spatial.neighbour_join(rows.where("id = 0"), rows, 5.0, circle).count()
    assert count(False) == 3 and count(True) == 2


def test_rtree_compat_matches_sqlite(spark):
    rng = np.random.default_rng(1)
    xy = np.column_stack([518800 + rng.random(2000) * 50, 4252300 + rng.random(2000) * 50])
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using rtree(id, x0, x1, y0, y1)")
    con.executemany("insert into t values (?, ?, ?, ?, ?)", [(i, x, x, y, y) for i, (x, y) in enumerate(xy.tolist())])
    cloud = points(spark, [(x, y, 0) for x, y in xy.tolist()]).cache()
    for cx, cy, h in [(518820.3, 4252310.7, 2.1), (518840.9, 4252333.3, 4.4), (518811.1, 4252320.2, 0.7)]:
        box = Box.around(cx, cy, h)
        want = {r[0] for r in con.execute("select id from t where x0 between ? and ? and y0 between ? and ?", (box.xmin, box.xmax, box.ymin, box.ymax))}
        assert {r.id for r in spatial.in_box(cloud, box, rtree_compat=True).collect()} == want and want


def test_neighbours_on_an_edge_and_copies_of_points(spark):
    """A point that rounding puts on the edge of a square is found; points, not probes, are copied, to 2.25 tiles each."""
    edge = points(spark, [(1 - 2.0**-53, 0.5, 0), (2.0, 0.5, 0)])
    assert {(r.id, r.n_id) for r in spatial.neighbour_join(edge, edge, 1.0).collect()} >= {(0, 1)}
    rng = np.random.default_rng(3)
    cloud = points(spark, [(*p, 0) for p in (rng.random((2000, 2)) * 40).tolist()])
    copies = cloud.select(spatial.reached(F.col("easting"), spatial.TILE_RADII, 1.0), "northing").select(spatial.reached(F.col("northing"), spatial.TILE_RADII, 1.0)).count()
    assert copies < 2.5 * 2000


def test_knn_in_sparse_and_small_clouds(spark):
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.random((150, 2)), rng.random((20, 2)) * 300])
    got = {}
    for r in paths.knn_edges(points(spark, [(*p, 0) for p in xy.tolist()]), 4).collect():
        got.setdefault(r.src, []).append((r.dist, r.dst))
    for i in range(len(xy)):
        d = np.hypot(*(xy - xy[i]).T)
        want = sorted((float(d[j]), j) for j in range(len(xy)) if j != i)[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]
    few = paths.knn_edges(points(spark, [(0, 0, 0), (500, 0, 0), (0, 900, 0)]), 8).collect()
    assert len(few) == 6
    assert paths.knn_edges(points(spark, []), 8).count() == 0


def patches(n, corners, seed=5):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.random((n, 2)) * n**0.5 + np.array(c) for c in corners])


def test_knn_of_far_patches_costs_what_near_ones_do(spark):
    """Candidate pairs of two patches 100 km apart, a diagonal strip and dense spots stay within a bound a point."""
    rng = np.random.default_rng(6)
    strip = np.arange(4000)[:, None] * [25.0, 25.0] + rng.random((4000, 2))
    spots = np.concatenate([patches(1500, [(0, 0)]), rng.random((1500, 2)) * 0.01 + 17, patches(1000, [(9e5, 3e5)]) * 2])
    for xy in (patches(2000, [(0, 0), (70_000, 70_000)]), strip, spots):
        cloud = points(spark, [(*p, 0) for p in xy.tolist()]).cache()
        leaves = density.sample_leaves(cloud)
        there, ask = density.with_leaf(cloud, leaves), density.with_leaf(cloud.select("id", "easting", "northing"), leaves, leaves.radius(9))
        asked = ask.groupBy("_leaf", "_class").agg(F.min("easting"), F.min("northing"), F.max("easting"), F.max("northing")).collect()
        sent = {(int(leaf), r["_class"]) for r in asked for leaf in leaves.within(np.array(r[2:]), 2 ** (r["_class"] / 2))}
        met = spatial._circle_join(ask, there, sent, ("id", "easting", "northing"))
        assert met.count() < 9 * 12 * len(xy)
        assert met.groupBy("id").count().where("count >= 9").count() > 0.9 * len(xy)
        near = {(r.src, r.dst) for r in paths.knn_edges(cloud, 8).collect()}
        some = rng.choice(len(xy), 200, replace=False)
        for i in some:
            d = ((xy - xy[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            assert {(i, int(j)) for j in np.lexsort((np.arange(len(xy)), d))[:8]} <= near
        assert len(near) == 8 * len(xy)


def test_knn_of_heaped_and_odd_points(spark):
    rng = np.random.default_rng(7)
    xy = np.concatenate([np.full((3000, 2), 5.0), rng.random((500, 2)) * 10])
    cloud = points(spark, [(*p, 0) for p in xy.tolist()])
    odd = spark.createDataFrame([(9001, None, 1.0, 0.0), (9002, math.nan, 1.0, 0.0), (9003, 1.0, math.inf, 0.0)], P)
    got = spatial.knn_join(cloud.select("id", "easting", "northing").union(odd.select("id", "easting", "northing")), cloud.union(odd), 5).groupBy("id").agg(F.sort_array(F.collect_list("n_id")).alias("near")).collect()
    assert len(got) == len(xy)
    for r in got[:: 40]:
        d = ((xy - xy[r.id]) ** 2).sum(axis=1)
        d[r.id] = np.inf
        assert r.near == sorted(np.lexsort((np.arange(len(xy)), d))[:5].tolist())
    far = spark.createDataFrame([(1, 1e6, 0.0), (2, 5.0, 5.0)], "id long, easting double, northing double")
    found = {(r.id, r.n_id) for r in spatial.knn_join(far, cloud, 3, itself=True).collect()}
    d = ((xy - [1e6, 0]) ** 2).sum(axis=1)
    assert found == {(1, int(j)) for j in np.lexsort((np.arange(len(xy)), d))[:3]} | {(2, 0), (2, 1), (2, 2)}
    assert spatial.knn_join(far.where("false"), cloud, 3).count() == 0 and spatial.knn_join(far, cloud.where("false"), 3).count() == 0


def test_knn_search_gives_a_row_a_probe(spark):
    """A search returns each probe once with at most k, so that no other pair is shuffled, sorted or written."""
    xy = patches(500, [(0, 0), (900, 40)])
    cloud = points(spark, [(*p, 0) for p in xy.tolist()])
    leaves = density.sample_leaves(cloud)
    there, ask = density.with_leaf(cloud, leaves), density.with_leaf(cloud.select("id", "easting", "northing"), leaves, leaves.radius(9))
    classes = [r["_class"] for r in ask.select("_class").distinct().collect()]
    sent = {(leaf, c) for leaf in range(len(leaves.counts)) for c in classes}
    found = {r.id: r for r in spatial._nearest(ask, there, sent, ("id",), 8, "id").collect()}
    assert len(found) == len(xy)
    for i in range(0, len(xy), 20):
        d = ((xy - xy[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        want = [int(j) for j in np.lexsort((np.arange(len(xy)), d))[:8]]
        assert found[i].n_id == want[: len(found[i].n_id)] and found[i].d2 == d[found[i].n_id].tolist()


def test_rays_meet_points_by_tile(spark):
    """Losses are those of all samples with all points; ceilings are a row for each tile, not for each cell and its neighbours."""
    rng = np.random.default_rng(11)
    xyz = np.column_stack([rng.random((1500, 2)) * 20, rng.random(1500) * 4])
    cloud = points(spark, xyz.tolist())
    ends = [(0, c, 1.0, 1.0, 3.0, *(rng.random(2) * 20).tolist(), 2.0) for c in range(30)]
    rays = spark.createDataFrame(ends, "tx int, cell long, tx_x double, tx_y double, tx_h double, x double, y double, z double").withColumn("lam", F.lit(0.125)).withColumn("d", F.expr("sqrt(pow(x - tx_x, 2) + pow(y - tx_y, 2) + pow(z - tx_h, 2))"))
    got = {r.cell: r.loss for r in coverage.diffraction(rays, cloud).collect()}
    want = {}
    for _, c, ax, ay, az, bx, by, bz in ends:
        d = math.dist((ax, ay, az), (bx, by, bz))
        for t in 0.1 + np.arange(8) * 0.8 / 7:
            at = np.array([ax, ay, az]) + t * (np.array([bx, by, bz]) - [ax, ay, az])
            near = xyz[(((xyz[:, :2] - at[:2]) ** 2).sum(axis=1) <= 0.36) & (xyz[:, 2] > at[2] + 0.05)]
            for h in near[:, 2] - at[2]:
                w = h * math.sqrt(2 * d / (0.125 * d * t * (d - d * t))) - 0.1
                want[c] = max(want.get(c, 0), 15 + max(0, 6.9 + 20 * math.log10(math.sqrt(w * w + 1) + w)))
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)
    tile = spatial.TILE_RADII * 0.6
    held = cloud.select(spatial.cell(F.col("easting"), tile).alias("jx"), spatial.cell(F.col("northing"), tile).alias("jy"), F.col("altitude").alias("oz"))
    assert coverage.tops(held).count() <= 81


def test_snapshot_tasks_write_several_files(spark, tmp_path, monkeypatch):
    """Many files come from few tasks, in files of no more rows than asked for, and are read by their folder."""
    monkeypatch.setattr(snapshots, "TASKS", 2)
    path = str(tmp_path / "table")
    rng = np.random.default_rng(4)
    snapshots.append(points(spark, [(*p, 0) for p in (rng.random((2000, 2)) * 40).tolist()]), path, rows=50)
    index = snapshots.files(spark, path).collect()
    assert len(index) >= 40 and max(r.rows for r in index) <= 50 and sum(r.rows for r in index) == 2000
    assert len({r.file.split("/part-")[1][:5] for r in index}) == 2
    assert len(snapshots._folders(spark, path, [r.file for r in index])) == 1 and len(snapshots._folders(spark, path, [r.file for r in index[:3]])) == 3
    assert snapshots.read(spark, path).select("id").distinct().count() == 2000


def test_leaves_cover_the_plane():
    xy = patches(3000, [(0, 0), (1e5, 3.0)])
    leaves = density.cut_leaves(xy, 6000, (0.0, 0.0, 1e5, 60.0))
    rng = np.random.default_rng(9)
    spots = np.concatenate([xy, rng.normal(size=(500, 2)) * 1e6])
    leaf = leaves.find(*spots.T)
    region = leaves.regions[leaf]
    assert ((spots >= region[:, :2]) & (spots <= region[:, 2:])).all()
    assert leaves.counts.sum() == pytest.approx(6000) and (leaves.boxes[:, 2] - leaves.boxes[:, 0]).max() < 60


def test_paths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y), 0.0, float(s)) for i, (x, y, s) in enumerate(rng.random((120, 3)) * [10, 10, 1])]
    cloud = spark.createDataFrame(rows, P + ", trav_score double")
    edges = paths.costed(paths.knn_edges(cloud, 6), cloud)
    after = {}
    for r in edges.collect():
        after.setdefault(r.src, []).append((r.dst, r.cost))
    best, heap = {7: 0.0}, [(0.0, 7)]
    while heap:
        c, at = heapq.heappop(heap)
        for to, w in after[at] if c == best[at] else []:
            if c + w < best.get(to, math.inf):
                best[to] = c + w
                heapq.heappush(heap, (c + w, to))
    for n in (1, 5):
        tiles = cloud.selectExpr("id", f"cast(id % {n} as int) as tile")
        assert {r.id: r.cost for r in paths.distances(edges, tiles, 7).collect()} == pytest.approx(best)
    for tile in (20, 10_000):
        path = paths.shortest_path(cloud, (0.0, 0.0), (10.0, 10.0), 6, tile=tile).orderBy("step").collect()
        assert path and [r.step for r in path] == list(range(len(path))) and path[-1].cost >= path[0].cost == 0
    apart = spark.createDataFrame([(i, float(i % 3) + 1000 * (i // 3), 0.0, 0.0, 1.0) for i in range(6)], P + ", trav_score double")
    assert paths.shortest_path(apart, (0, 0), (1001, 0), 2).count() == 0
    assert paths.shortest_path(apart.where("false"), (0, 0), (1, 0), 2).count() == 0


def heap_walk(edges, start):
    """Costs and last points, by one heap over all; of ties the smaller id over an edge with a length."""
    after, best, heap, done = {}, {start: (0.0, None)}, [(0.0, start)], set()
    for a, b, c in edges:
        after.setdefault(a, []).append((b, c))
    while heap:
        cost, at = heapq.heappop(heap)
        if at in done:
            continue
        done.add(at)
        for to, c in after.get(at, ()):
            if to not in best or cost + c < best[to][0]:
                best[to] = cost + c, at
                heapq.heappush(heap, (cost + c, to))
            elif c > 0 and cost + c == best[to][0] and best[to][1] is not None and at < best[to][1]:
                best[to] = best[to][0], at
    return best


def test_equally_cheap_ways(spark):
    # 0 -> 9 costs 2 over 5 (found first), over 1 and 2 (more hops), and over the pair 3, 4 without distance
    edges = [(0, 5, 1.0), (5, 9, 1.0), (0, 1, 0.5), (1, 2, 0.5), (2, 9, 1.0), (0, 3, 1.5), (3, 4, 0.0), (4, 3, 0.0), (4, 9, 0.5), (3, 9, 0.5)]
    graph = spark.createDataFrame(edges, "src long, dst long, cost double")
    want = {0: (0.0, None), 5: (1.0, 0), 1: (0.5, 0), 2: (1.0, 1), 3: (1.5, 0), 4: (1.5, 3), 9: (2.0, 2)}
    for n in (1, 2, 10):
        tiles = spark.range(10).selectExpr("id", f"cast(id % {n} as int) as tile")
        assert {r.id: (r.cost, r.prev) for r in paths.distances(graph, tiles, 0).collect()} == want
    rng = np.random.default_rng(4)
    ties = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(1, 4, 300)) if a != b]
    for n in (1, 7):
        got = paths.distances(spark.createDataFrame(ties, "src long, dst long, cost double"), spark.range(40).selectExpr("id", f"cast(id % {n} as int) as tile"), 0)
        assert {r.id: (r.cost, r.prev) for r in got.collect()} == heap_walk(ties, 0)


def test_path_over_many_tiles(spark):
    """The same path as one heap finds, over a cloud of 60 tiles; rounds are not many more than tiles crossed."""
    rng = np.random.default_rng(12)
    rows = [(i, float(x), float(y), 0.0, float(s)) for i, (x, y, s) in enumerate(np.column_stack([rng.random(6000) * 600, rng.random(6000) * 40, rng.random(6000)]))]
    cloud = spark.createDataFrame(rows, P + ", trav_score double").cache()
    edges = cut(paths.costed(paths.knn_edges(cloud, 8), cloud))
    places = cut(paths.tiles_of(cloud, 150))
    start, goal = (spatial.nearest_point(cloud, *p).first().id for p in ((0, 0), (600, 40)))
    reached = paths.search(edges, places, start, goal)
    assert len({r.tile for r in places.select("tile").distinct().collect()}) > 40
    want = heap_walk([(r.src, r.dst, r.cost) for r in edges.collect()], start)
    way, at = [], goal
    while at is not None:
        way.append((at, want[at][0]))
        at = want[at][1]
    assert paths.way_back(reached, places.where(F.col("id") == goal).first().tile, goal) == way[::-1]
    assert len(reached.rounds) < 100


def test_utm_round_trip(spark):
    rows = spark.createDataFrame([(float(e), float(n), z, h) for e in (200000, 500000, 812345.678) for n in (100.5, 4252965.37, 9300000) for z in (1, 15, 60) for h in (True, False)], "e double, n double, z int, h boolean")
    there = utm.with_latlon(rows, F.col("e"), F.col("n"), F.col("z"), F.col("h"))
    e, n = utm.from_latlon(F.col("latitude"), F.col("longitude"), F.col("z"), F.col("h"))
    for r in there.withColumn("e2", e).withColumn("n2", n).collect():
        assert (r.e2, r.n2) == pytest.approx((r.e, r.n), abs=1e-5)
    middle = utm.with_latlon(rows.where("e = 500000 and n = 100.5 and h"), F.col("e"), F.col("n"), F.col("z"), F.col("h")).collect()
    assert [round(r.longitude) for r in middle] == [6 * r.z - 183 for r in middle]


def test_csv_projection(spark, tmp_path):
    (tmp_path / "in.csv").write_text("name,easting,northing,zone\n" + "a,500000,4649776,33N\n" + "b,x,1,33N\n" + "c,500000,1,\n" + "d,500000,5350224,15T\n")
    bad = tables.project_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), 1)
    assert sorted(r.name for r in bad.collect()) == ["b", "c"]
    out = spark.read.csv(str(tmp_path / "out"), header=True).orderBy("name").collect()
    assert [(r.name, r.longitude) for r in out] == [("a", "15.000000"), ("d", "-93.000000")] and out[0].latitude.startswith("41.99") and out[1].latitude.startswith("-4")


def test_patterns(spark):
    want = [(0.0, 1.0), (350.0, 2.0)]
    for raw in ({"0": 1, "-10": 2}, [[0, 1], [-10, 2]], [{"angle": 0, "gain": 1}, {"angle": 350, "gain": 2}], [{"a": 0, "g": 1}, {"a": 350, "g": 2}], ["0,1", "350:2"], ["0 1", "bad", "-10 2", [None, 1]]):
        assert radio.parse_pattern(raw) == want
    assert radio.parse_pattern("0,1") == [] == radio.parse_pattern(None)
    assert radio.parse_pattern([{"a": 5, "b": 9, "c": 7}, [5, 1], {"x": 4}, [725, 3]]) == [(5.0, 9.0), (5.0, 1.0), (5.0, 3.0)]
    p = spark.createDataFrame([([[-30.0, -18.0], [-10.0, -3.0], [0.0, 0.0], [10.0, -3.0], [30.0, -12.0]],)], "p array<array<double>>")
    at = lambda a: radio.interpolate(radio.normal_pattern(F.col("p")), F.lit(a))
    assert p.select(at(350.0), at(90.0)).first()[:] == pytest.approx((-3.0, -13.2))
    assert spark.createDataFrame([([],)], "p array<array<double>>").select(at(3.0)).first()[0] is None


def test_las_round_trip(spark, tmp_path):
    las.register(spark)
    cloud = tables.cloud(spark, SF)
    cloud.repartition(3).select("easting", "northing", "altitude", "class_code").write.format("las").option("zone", "12N").mode("append").save(str(tmp_path / "las"))
    back = spark.read.format("las").option("range", 100).load(str(tmp_path / "las"))
    assert back.count() == cloud.count() and {r.zone for r in back.select("zone").distinct().collect()} == {"12N"}
    keys = lambda df: sorted((round(r.easting, 3), round(r.northing, 3), round(r.altitude, 3), r.class_code) for r in df.collect())
    assert np.allclose(np.array(keys(back), float), np.array(keys(cloud), float), atol=2e-3)
    assert back.select("id").distinct().count() == back.count()
    one = sorted(str(p) for p in (tmp_path / "las").glob("*.las"))[0]
    (tmp_path / "bad.las").write_bytes(b"LASF" + b"\0" * 400)
    data = bytearray(open(one, "rb").read())
    data[104] |= 128
    (tmp_path / "z.laz.las").write_bytes(bytes(data))
    done = {os.path.basename(r.src): r for r in las.convert(spark, [one, str(tmp_path / "z.laz.las"), str(tmp_path / "none.las")], str(tmp_path / "conv")).collect()}
    assert done[os.path.basename(one)].ok and "LAZ" in done["z.laz.las"].error and not done["none.las"].ok
    with pytest.raises(FileNotFoundError):
        las.files_of(str(tmp_path / "conv" / "missing"))
    vlr = lambda text: [("other", 1, text.encode(), "")]
    assert [las.zone_of(vlr(t)) for t in ("utm ZONE 12s", "UTM zone15", "none")] == ["12S", "15?", None]
    assert struct.unpack_from("<Q", data, 247)[0] > 0
    copied = spark.read.format("las").load(str(tmp_path / "conv"))
    assert keys(copied) == keys(back.where(F.col("file") == os.path.basename(one))) and copied.first().zone == "12N"


def test_las_ids_stay_when_files_come(spark, tmp_path):
    las.register(spark)
    xyz = np.array([[1.0, 2.0, 3.0], [4.5, 5.25, -6.125]])
    path = str(tmp_path / "some")
    os.makedirs(path)
    ids = lambda: {(r.file, r.easting): r.id for r in spark.read.format("las").load(path).collect()}
    for name in ("m", "z"):
        las.write_file(f"{path}/{name}.las", xyz, np.array([2, 5]), "12N")
    before = ids()
    las.write_file(f"{path}/a.las", xyz, np.array([2, 5]), "12N")
    after = ids()
    assert len(before) == 4 and len(after) == len(set(after.values())) == 6 and before.items() <= after.items()
    many = [f"{k}.las" for k in range(100_000)]
    assert len(set(las.numbers_of(many))) == len(many)


def test_las_stream_reads_each_file_once(spark, tmp_path):
    las.register(spark)
    folder, out = tmp_path / "las", str(tmp_path / "out")
    folder.mkdir()

    def put(name, n):
        las.write_file(str(folder / name), np.arange(3 * n).reshape(n, 3).astype(float), np.zeros(n, np.uint8), "12N")

    def run():
        stream = spark.readStream.format("las").option("range", 40).load(str(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out).awaitTermination()
        return {r.file: (r["count"], r.ids) for r in spark.read.parquet(out).groupBy("file").agg(F.count("*").alias("count"), F.count_distinct("id").alias("ids")).collect()}

    put("m.las", 100)
    put("b.las", 70)
    (folder / "half.las.tmp").write_bytes(b"LASF")
    assert run() == {"m.las": (100, 100), "b.las": (70, 70)}
    assert run() == {"m.las": (100, 100), "b.las": (70, 70)}
    put("a.las", 30)  # before the others by name, after them by arrival
    put("z.las", 0)
    assert run() == {"m.las": (100, 100), "b.las": (70, 70), "a.las": (30, 30)}
    commits = sorted((tmp_path / "check" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink()
    put("c.las", 20)  # comes before the last batch is repeated, and isn't in it
    assert run() == {"m.las": (100, 100), "b.las": (70, 70), "a.las": (30, 30)}
    assert run() == {"m.las": (100, 100), "b.las": (70, 70), "a.las": (30, 30), "c.las": (20, 20)}
    assert spark.read.parquet(out).select("id").distinct().count() == 220
    ids = {r.id for r in spark.read.format("las").load(str(folder)).select("id").collect()}
    assert ids == {r.id for r in spark.read.parquet(out).select("id").collect()}
    reader = las.LasStream({"path": str(folder), "files": "1", "log": str(tmp_path / "log")})
    assert [reader.latestOffset()["entries"] for _ in range(6)] == [1, 2, 3, 4, 5, 5] and len(reader.partitions({"entries": 5}, {"entries": 5})) == 0


def test_las_writer_leaves_nothing_behind(spark, tmp_path):
    las.register(spark)
    rows = spark.createDataFrame([(float(i), 1.0, 0.0, 2) if i != 77 else (None, 1.0, 0.0, 2) for i in range(100)], "easting double, northing double, altitude double, class_code int")
    with pytest.raises(Exception):
        rows.repartition(4).write.format("las").mode("append").save(str(tmp_path / "x"))
    rows.dropna().write.format("las").mode("append").save(str(tmp_path / "x"))
    assert {p.suffix for p in (tmp_path / "x").iterdir()} == {".las"}


def test_las_parts_and_odd_points(spark, tmp_path, monkeypatch):
    """Files of a bounded number of points, nulls as zeros, a short file and an empty table."""
    las.register(spark)
    monkeypatch.setattr(las, "FILE", 300)
    monkeypatch.setattr(las, "RANGE", 70)
    xyz = np.random.default_rng(3).random((1000, 3)).round(3) * 100
    writer = las.LasWriter({"path": str(tmp_path / "parts"), "zone": "12N"}, overwrite=True)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0, "taskAttemptId": lambda self: 7})())
    table = pa.table({"easting": xyz[:, 0], "northing": xyz[:, 1], "altitude": xyz[:, 2], "class_code": np.arange(1000) % 7})
    for _ in range(2):
        writer.commit([writer.write(iter(table.to_batches(max_chunksize=110))), None])
    paths = las.files_of(str(tmp_path / "parts"))
    assert [las.Header(p).count for p in paths] == [300, 300, 300, 100]
    las.copy_file(paths[0], str(tmp_path / "copy.las"))
    for path, want in ((paths[0], xyz[:300]), (str(tmp_path / "copy.las"), xyz[:300]), (paths[3], xyz[900:])):
        got = pa.Table.from_batches(las.LasReader({"path": path}).read(las.Range(path, 1, 0, len(want)))).to_pydict()
        assert np.allclose(np.column_stack([got[c] for c in ("easting", "northing", "altitude")]), want, atol=6e-4) and len(set(got["id"])) == len(want)
        bounds = struct.unpack_from("<6d", open(path, "rb").read(375), 179)
        assert np.allclose(bounds[::2], want.max(axis=0), atol=6e-4) and np.allclose(bounds[1::2], want.min(axis=0), atol=6e-4)
    (tmp_path / "short.las").write_bytes(open(paths[0], "rb").read()[:-10])
    with pytest.raises(ValueError, match="ends before"):
        list(las.chunks(str(tmp_path / "short.las"), las.Header(paths[0]), 0, 300))
    with pytest.raises(ValueError):
        las.write_file(str(tmp_path / "far.las"), np.array([[0.0, 0.0, 0.0], [1e9, 0.0, 0.0]]), np.array([0, 0]))
    las.write_file(str(tmp_path / "none.las"), np.zeros((0, 3)), np.zeros(0, int))
    assert las.Header(str(tmp_path / "none.las")).count == 0
    monkeypatch.undo()
    odd = spark.createDataFrame([(1.0, 2.0, None, None)], "easting double, northing double, altitude double, class_code int")
    odd.write.format("las").mode("append").save(str(tmp_path / "odd"))
    odd.where("false").write.format("las").mode("append").save(str(tmp_path / "odd"))
    assert spark.read.format("las").load("file:" + str(tmp_path / "odd")).drop("id", "file").collect() == [(1.0, 2.0, 0.0, 0, None)]


def test_tables(spark, tmp_path):
    cloud = tables.cloud(spark, SF)
    tables.write_points(cloud, str(tmp_path / "p"), side=5.0, files=4)
    box = Box(518810.0, 518812.0, 4252301.0, 4252303.0)
    read = tables.read_points(spark, str(tmp_path / "p"), box, side=5.0)
    assert spatial.in_box(read, box).count() == spatial.in_box(cloud, box).count() and read.count() < cloud.count()
    tables.compact(spark, str(tmp_path / "p"), str(tmp_path / "q"), 1)
    assert spark.read.parquet(str(tmp_path / "q")).count() == cloud.count()
    tables.views(cloud, {"low": "altitude < 1301"})
    assert spark.table("low").count() == cloud.where("altitude < 1301").count()
    tables.write_ndjson(cloud, str(tmp_path / "n"))
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "n")).collect()]
    meta = [x["_meta"] for x in lines if "_meta" in x]
    assert len(lines) == cloud.count() + 1 and meta[0]["count"] == cloud.count() and len(meta[0]["bounds"]) == 6
    assert summaries.cloud_summary(cloud.where("false")).first()[:] == (0,) + (0.0,) * 9


def grid_cloud(spark, n=200):
    """A point each half metre over a square of n / 2 metres."""
    return spark.range(n * n).selectExpr("id", f"id % {n} * 0.5d as easting", f"floor(id / {n}) * 0.5d as northing", "cast(id % 7 as double) as altitude")


def test_sql_functions_reach_the_scan(spark, tmp_path):
    cloud = grid_cloud(spark, 40)
    cloud.write.parquet(str(tmp_path / "p"))
    sql.register(spark.read.parquet(str(tmp_path / "p")), "_grid")
    plan = lambda q: spark.sql(q)._jdf.queryExecution().executedPlan().toString()
    box = plan("SELECT id FROM points_in(5, 5, 1)")
    assert "PushedFilters: [IsNotNull(easting), IsNotNull(northing), GreaterThanOrEqual(easting,4.0)" in box
    assert "altitude" not in box.split("ReadSchema")[1].split(">")[0]
    assert "GreaterThanOrEqual(alt" in plan("SELECT * FROM points_between(2, 3)")
    assert "TakeOrderedAndProject" in plan("SELECT * FROM nearest_to(5, 5, 4)") and "Cartesian" not in plan("SELECT * FROM neighbours_within(1.0)") and "NestedLoop" not in plan("SELECT * FROM neighbours_within(1.0)")
    spans = spark.sql("SELECT id FROM points_spanning(5, 6, 3, 2, 0.5)").count()
    assert spans == spatial.in_box(cloud, Box.spanning((5.0, 6.0), (3.0, 2.0), 0.5)).count() > 0
    assert spark.sql("SELECT * FROM points_in(5, 5, NULL)").count() == 0
    assert [r.id for r in spark.sql("SELECT id FROM nearest_to(0.1, 0, 2) ORDER BY rank").collect()] == [0, 1]


def test_snapshots_open_few_files(spark, tmp_path):
    path, cloud = str(tmp_path / "s"), grid_cloud(spark)
    snapshots.append(cloud, path, rows=400)
    index = snapshots.files(spark, path)
    assert index.count() == 100 and index.agg(F.sum("rows")).first()[0] == 40_000
    for box in (Box(40.0, 50.0, 40.0, 50.0), Box(3.0, 13.0, 71.0, 81.0), Box(-9.0, 1.0, 99.0, 120.0)):
        got = snapshots.read(spark, path, box)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in spatial.in_box(cloud, box).collect())
        # the layout by cell columns, whose files Spark opens all 100 of for their statistics
        assert len(got.inputFiles()) <= 12
    assert snapshots.read(spark, path, Box(1e6, 1e7, 0.0, 1.0)).count() == 0
    assert spark.range(1).select(*[snapshots.z_key(F.lit(float(x)), F.lit(float(y)), 1.0).alias(f"z{x}{y}") for x, y in ((0, 0), (1, 0), (0, 1), (1, 1))]).first()[:] == tuple(0x3 << 60 | k for k in range(4))


def test_snapshots_change_touched_files_only(spark, tmp_path, monkeypatch):
    path, cloud = str(tmp_path / "s"), grid_cloud(spark, 60)
    assert snapshots.versions(spark, path) == [] and snapshots.last_batch(spark, path) == -1
    first = snapshots.append(cloud, path, rows=200)
    names = lambda v=None: {r.file for r in snapshots.files(spark, path, v).collect()}
    low = spark.createDataFrame([(0, -1.0), (1, -2.0), (10**9, 5.0)], "id long, altitude double")
    second = snapshots.update(spark, path, low, rows=200)
    assert len(names(first) - names(second)) == 1 == len(names(second) - names(first))
    heights = {r.id: r.altitude for r in snapshots.read(spark, path).collect()}
    assert heights == {r.id: r.altitude for r in cloud.collect()} | {0: -1.0, 1: -2.0}
    assert snapshots.update(spark, path, low.withColumn("altitude", F.lit(9.0)), box=Box(-1.0, 1.0, -1.0, 1.0), rows=200) == 3
    moved = spark.createDataFrame([(5, 29.0, 29.0, 1.0), (9999, 0.25, 0.25, 2.0)], "id long, easting double, northing double, altitude double")
    third = snapshots.merge(spark, path, moved, spark.createDataFrame([(7,), (8,), (12345,)], "id long"), batch=4, rows=200)
    assert snapshots.read(spark, path).count() == 3600 - 2 + 1 and snapshots.last_batch(spark, path) == 4
    assert {r.id for r in snapshots.read(spark, path, Box(28.9, 29.1, 28.9, 29.1)).collect()} >= {5}
    # a job that dies before its index is complete leaves the snapshot before
    before = snapshots.read(spark, path).count()
    real = snapshots.INDEX
    monkeypatch.setattr(snapshots, "INDEX", real.replace("rows bigint", "none_such bigint"))
    with pytest.raises(Exception):
        snapshots.append(cloud, path, rows=200)
    monkeypatch.setattr(snapshots, "INDEX", real)
    os.makedirs(f"{path}/index/{third + 1:08d}/_temporary", exist_ok=True)
    assert snapshots.versions(spark, path)[-1] == third and snapshots.read(spark, path).count() == before
    fourth = snapshots.append(cloud.limit(3).withColumn("id", F.col("id") + 50_000), path)
    assert fourth == third + 1 and snapshots.last_batch(spark, path) == 4
    # compaction leaves large files alone
    large = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in (r.file for r in snapshots.files(spark, path).where("rows >= 100").collect())}
    snapshots.append(cloud.limit(5).withColumn("id", F.col("id") + 60_000), path)
    content = sorted(map(tuple, snapshots.read(spark, path).collect()))
    assert snapshots.compact(spark, path, 100) is not None
    assert {f: os.stat(f"{path}/{f}").st_mtime_ns for f in large} == large and large.keys() <= names()
    assert snapshots.files(spark, path).where("rows < 100").count() <= 1 and sorted(map(tuple, snapshots.read(spark, path).collect())) == content
    assert snapshots.compact(spark, path, 1) is None
    assert snapshots.vacuum(spark, path) > 0 and len(snapshots.versions(spark, path)) == 1
    assert sorted(map(tuple, snapshots.read(spark, path).collect())) == content
    empty = str(tmp_path / "e")
    snapshots.append(cloud.where("false"), empty)
    assert snapshots.read(spark, empty).count() == 0 and snapshots.read(spark, empty).columns == cloud.columns
    snapshots.merge(spark, empty, cloud.limit(2))
    assert snapshots.read(spark, empty).count() == 2
    with pytest.raises(ValueError):
        snapshots.read(spark, str(tmp_path / "none"))


def test_stream_of_changes(spark, tmp_path):
    """Inserts, moves and deletions leave the metrics that a computation over the last points gives; no batch counts twice."""
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y), float(z), 1, 2) for i, (x, y, z) in enumerate(rng.random((400, 3)) * [12, 12, 1])]
    path, source = str(tmp_path / "store"), str(tmp_path / "in")
    changes.create(spark.createDataFrame(rows[:300], POINTS), path, rows=60)
    known = {r[0]: r for r in rows[:300]}
    batches = [
        [(*r, False, 0) for r in rows[300:]],
        [(i, None, None, None, None, None, True, 5) for i in range(0, 90, 3)] + [(7, *rows[7][1:], True, 1), (7, 1.0, 1.0, 1.0, 1, 2, False, 2), (4444, None, None, None, None, None, True, 1), (None, 1.0, 1.0, 1.0, 1, 1, False, 1)],
        [(i, 12.0 - known[i][1], known[i][2], 0.5, 1, 2, None, 9) for i in range(1, 60, 3)] + [(0, 6.0, 6.0, 2.0, 1, 2, False, 1), (1, None, 3.0, 1.0, 1, 1, False, 99)],
    ]
    want = known | {r[0]: r for r in rows[300:]}
    for batch in batches[1:]:
        for *r, gone, _ in batch:
            if r[0] is None or not gone and r[1] is None:
                continue
            want.pop(r[0], None)
            if not gone:
                want[r[0]] = tuple(r)
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, changes.CHANGES).coalesce(1).write.mode("append").parquet(source)
        changes.follow(spark, source, path, str(tmp_path / "check"), files=1, rows=60).awaitTermination()
        assert snapshots.last_batch(spark, path) == k
    version = snapshots.versions(spark, path)[-1]
    final = spark.createDataFrame(list(want.values()), POINTS)
    fresh = terrain.with_metrics(final, terrain.terrain_metrics(final)).select(*PROCESSED.names)
    got, expected = (sorted(map(tuple, df.collect())) for df in (snapshots.read(spark, path), fresh))
    assert [r[:6] for r in got] == [r[:6] for r in expected] and any(r[6] is None for r in got) or len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g[0] == e[0] and (g[6:] == e[6:] or g[6:] == pytest.approx(e[6:], abs=1e-9))
    # the last batch again, as after a failure before its checkpoint was written
    commits = sorted((tmp_path / "check" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink()
    changes.follow(spark, source, path, str(tmp_path / "check"), files=1, rows=60).awaitTermination()
    assert snapshots.versions(spark, path)[-1] == version


def test_cleared_cuts(spark):
    from lidarspark.operators import cuts

    made = cut(spark.range(5))
    folder = cuts.shared_folder(spark).removeprefix("file:")
    spark.range(3).write.parquet(cuts.scratch(spark, "x"))
    assert made.count() == 5 and len(os.listdir(folder)) >= 2
    cuts.clear(spark)
    assert os.listdir(folder) == [] and cut(spark.range(4)).count() == 4


def test_antenna_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"gain_db": 3.0, "azimuth_pattern": [[0, 3]]}))
    (tmp_path / "b.json").write_text(json.dumps({"name": "AMY-9M16", "gain_db": 9.0}))
    (tmp_path / "c.json").write_text("not json")
    got = {r.name: r.gain_db for r in tables.antenna_configs(spark, str(tmp_path)).collect()}
    assert got == {"a": 3.0, "AMY-9M16": 9.0, "AM-2G16-90": 16.0, "AM-5G20-90": 20.0}
    assert {r.name for r in tables.antenna_configs(spark).collect()} == {a["name"] for a in ANTENNAS} == {r.name for r in default_antennas(spark).collect()}


def test_survey(spark):
    survey = Survey(tables.cloud(spark, SF)).load_box(518820.0, 4252302.0, 4.0).set_grid(2.0, 2.0)
    with pytest.raises(ValueError):
        survey.simulate()
    survey = survey.add_tx(518818.0, 4252302.0, h_m=1.5, ant_config="AM-2G16-90").add_tx(518822.0, 4252302.0, ant_config="unknown", rx_aperture_m=3.0)
    txs = survey.txs.orderBy("tx").collect()
    assert [t.tx for t in txs] == [0, 1] and txs[0].h_m > 1300 and txs[0].gain_db == 16.0 and txs[1].az is None
    raster = survey.simulate().toPandas()
    assert len(raster) == survey.grid.nx * survey.grid.ny and raster.rssi_dbm.between(-120, 40).all()
    assert survey.clear_txs().txs is None and survey.summary().first().n == survey.loaded.count()
    with pytest.raises(ValueError):
        survey.set_grid(0.0)


def test_smoothing_keeps_power(spark):
    grid = coverage.Grid(0, 9, 0, 4, 10, 5)
    rng = np.random.default_rng(5)
    mw = rng.random((5, 10))
    rows = [(0, i, j, float(mw[i, j])) for i in range(5) for j in range(10)]
    got = coverage.smooth(spark.createDataFrame(rows, "tx int, iy int, ix int, mw double"), grid, 1.0).toPandas().pivot(index="iy", columns="ix", values="mw").to_numpy()
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    w /= w.sum()
    pad = np.pad(mw, 4, mode="symmetric")
    want = np.apply_along_axis(np.convolve, 1, np.apply_along_axis(np.convolve, 0, pad, w, "valid"), w, "valid")
    assert np.allclose(got, want)


def test_stream_of_tiles(spark, tmp_path):
    cloud = tables.cloud(spark, SF).select(*POINTS.names)
    for k in range(2):
        cloud.where(f"id % 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        tiles.ingest(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "metrics"), str(tmp_path / "ck")).awaitTermination()
    got = tiles.latest(spark, str(tmp_path / "metrics")).select("id", "n", "slope").toPandas().sort_values("id", ignore_index=True)
    want = terrain.terrain_metrics(cloud, 1.0).select("id", "n", "slope").toPandas().sort_values("id", ignore_index=True)
    pd.testing.assert_frame_equal(got, want)
    table = spark.read.schema(POINTS).parquet(str(tmp_path / "table"))
    assert tiles.touched(table, table.where("false"), 1.0).count() == 0
    near = table.where("id = 5")
    some = tiles.touched(table, near, 1.0)
    assert "GreaterThanOrEqual(easting" in some._jdf.queryExecution().executedPlan().toString()
    alone = {r.id: r for r in terrain.terrain_metrics(cloud, 1.0).collect()}
    assert 0 < some.count() < table.count() and all(r.n == alone[r.id].n for r in some.collect())


def test_coverage_is_the_plain_version(spark):
    """rf_coverage and coarse_planes over the whole cloud, in numpy."""
    cloud = tables.cloud(spark, SF).toPandas().sort_values("id")
    xyz = cloud[["easting", "northing", "altitude"]].to_numpy()
    g = coverage.Grid.over(tables.cloud(spark, SF), 2.0, 20.0)
    n, m = math.ceil((g.xmax - g.xmin) / 10), math.ceil((g.ymax - g.ymin) / 10)
    nodes, found = [(x, y) for y in np.linspace(g.ymin, g.ymax, m) for x in np.linspace(g.xmin, g.xmax, n)], []
    for x, y in nodes:
        near = xyz[np.argsort((xyz[:, 0] - x) ** 2 + (xyz[:, 1] - y) ** 2, kind="stable")[:64]]
        mid = near.mean(axis=0)
        v = np.linalg.eigh((near - mid).T @ (near - mid))[1][:, 0]
        found.append((*mid, *(v if v[2] >= 0 else -v)))
    planes = np.array(found)
    got = registry.QUERIES["coarse_planes"](spark, SF).orderBy("node").toPandas()
    assert len(got) == n * m and np.allclose(got[["px", "py", "pz", "nx", "ny", "nz"]].to_numpy(), planes, atol=1e-6)

    sites = {r.tx: r for r in registry._sites(spark).collect()}
    specs = {a["name"]: a for a in ANTENNAS}

    def pattern(pairs, angle):
        own = sorted((a % 360, v) for a, v in pairs)
        a, v = [p[0] for p in own] + [own[0][0] + 360], [p[1] for p in own] + [own[0][1]]
        return float(np.interp(angle % 360, a, v))

    def power(t, spec, cell, plane):
        x, y, z = cell
        d = math.dist(cell, (t.x, t.y, t.h_m))
        az = math.degrees(math.atan2(y - t.y, x - t.x)) - (90 - t.heading_deg)
        el = math.degrees(math.atan2(z - t.h_m, math.hypot(x - t.x, y - t.y)))
        top = max(v for _, v in spec["elevation_pattern"])
        gain = pattern(spec["azimuth_pattern"], az) + spec["gain_db"] - max(v for _, v in spec["azimuth_pattern"]) + pattern(spec["elevation_pattern"], el) - (0 if abs(top) <= 2 else top)
        loss = 0.0
        for s in np.linspace(0.1, 0.9, 8):
            at = np.array([t.x, t.y, t.h_m]) + s * (np.array(cell) - [t.x, t.y, t.h_m])
            over = xyz[((xyz[:, :2] - at[:2]) ** 2).sum(axis=1) <= 0.36][:, 2]
            over = over[over > at[2] + 0.05]
            if len(over):
                v = (over.max() - at[2]) * math.sqrt(2 * d / (299792458 / t.freq_hz * d * s * (d - d * s)))
                loss = max(loss, 15 + (0 if v <= -0.78 else max(0, 6.9 + 20 * math.log10(math.sqrt((v - 0.1) ** 2 + 1) + v - 0.1))))
        p, normal = np.array(plane[:3]), np.array(plane[3:])
        side = (np.array([t.x, t.y, t.h_m]) - p) @ normal
        back = math.dist(cell, np.array([t.x, t.y, t.h_m]) - 2 * side * normal)
        cosine = min(1, max(0, side / math.dist(p, (t.x, t.y, t.h_m))))
        sine = math.sqrt(1 - cosine**2)
        st = sine / math.sqrt(6)
        ct, n2 = math.sqrt(1 - st * st), math.sqrt(6)
        rs, rp = (cosine - n2 * ct) / (cosine + n2 * ct), (n2 * cosine - ct) / (n2 * cosine + ct)
        size = (abs(rs) + abs(rp)) / 2 * (1 if (rs + rp) / 2 >= 0 else -1)
        total = 0.0
        for f in t.freq_hz * (1 + np.linspace(-0.005, 0.005, 5)):
            w, far = 299792458 / f, 2 * 0.1**2 / (299792458 / t.freq_hz)
            amplitude = lambda way: math.sqrt(10 ** (t.power_dbm / 10) / 1000 * 10 ** (gain / 10)) * w / (4 * math.pi * max(way, far)) * 10 ** (-loss / 20) * np.exp(-2j * math.pi * way / w)  # noqa: E731, B023
            rough = math.exp(-((4 * math.pi * 0.02 * sine / w) ** 2))
            total += abs(amplitude(d) + size * rough * amplitude(back)) ** 2 * 1000 / 5
        return total

    raster = registry.QUERIES["rf_coverage"](spark, SF).toPandas()
    assert len(raster) == g.nx * g.ny and raster.groupby(["iy", "ix"]).size().max() == 1
    for r in raster.iloc[:: max(1, len(raster) // 150)].itertuples():
        z = xyz[np.argmin((xyz[:, 0] - r.x) ** 2 + (xyz[:, 1] - r.y) ** 2), 2]
        node = int(np.argmin([(x - r.x) ** 2 + (y - r.y) ** 2 for x, y in nodes]))
        sums = sum(power(sites[k], specs[sites[k].ant_config], (r.x, r.y, z), planes[node]) for k in sites)
        assert r.z == pytest.approx(z) and r.rssi_dbm == pytest.approx(10 * math.log10(sums), abs=0.02), (r.iy, r.ix)


def test_coverage_and_planes_span_the_cloud(spark):
    g = coverage.Grid.over(tables.cloud(spark, SF), 2.0, 20.0)
    got = registry.QUERIES["rf_coverage"](spark, SF).toPandas()
    assert len(got) == g.nx * g.ny > 135
    assert (got.x.min(), got.x.max(), got.y.min(), got.y.max()) == pytest.approx((g.xmin, g.xmax, g.ymin, g.ymax))
    assert registry.QUERIES["coarse_planes"](spark, SF).count() == math.ceil((g.xmax - g.xmin) / 10) * math.ceil((g.ymax - g.ymin) / 10)
    assert got.groupby(["iy", "ix"]).size().max() == 1


def test_a_round_of_a_search_asks_the_driver_once(spark, monkeypatch):
    edges = spark.createDataFrame([(i, j, 1.0, 1.0) for i in range(30) for j in (i - 1, i + 1) if 0 <= j < 30], "src long, dst long, dist double, cost double")
    tiles = spark.range(30).selectExpr("id", "cast(id div 10 as int) as tile")
    asked, rounds, kind, add = [], [], type(edges), paths.Reached.add
    for name in ("collect", "first"):
        monkeypatch.setattr(kind, name, lambda self, *a, f=getattr(kind, name): asked.append(1) or f(self, *a))
    monkeypatch.setattr(paths.Reached, "add", lambda self, *a: rounds.append(1) or add(self, *a))
    found = paths.search(edges, tiles, 0, 29)
    assert len(asked) == 1 + len(rounds) and 3 <= len(rounds) <= 5
    assert paths.way_back(found, 2, 29) == [(i, float(i)) for i in range(30)]
    assert paths.TILE >= 100_000
