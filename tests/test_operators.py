"""Traps of the other operators on hand-made rows, and brute force for graph, raster and matrix work."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinderlake.operators import climate as C
from cinderlake.operators import geometry as X
from cinderlake.operators import graph as G
from cinderlake.operators import multivariate as M
from cinderlake.operators import raster as R
from cinderlake.operators import relational as T
from cinderlake.operators import size as Z
from cinderlake.sources import adapters as A
from cinderlake.streaming import incremental as I


def test_mode_takes_the_smallest_on_ties_and_no_zero(spark):
    df = spark.createDataFrame([(1, v) for v in (3, 3, 7, 7, 0, 0, 0)], "id int, v int")
    assert T.mode_by(df, ["id"], "v").first()["mode"] == 3


def test_assign_most(spark):
    pairs = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 3), ("c", 2), ("c", 3)], "f string, cell int")
    everyone = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "f string")
    assert {r["f"]: r["cell"] for r in T.assign_most(pairs, "f", "cell", everyone).collect()} == {"a": 1, "b": 1, "c": 3, "d": -99}


def test_years_outside_periods_are_null(spark):
    got = spark.createDataFrame([(1995,), (1998,), (2001,)], "year int").select(A.period_of(F.col("year")).alias("p"))
    assert [r["p"] for r in got.collect()] == ["1995-1996", "1997-1998", None]


def test_power_law_and_size_quantiles(spark):
    df = spark.createDataFrame([(1, x) for x in (0.03, 0.06, 0.09, 0.5, 2.0)], "id int, area double")
    assert tuple(Z.power_law(df, ["id"]).first())[1:] == pytest.approx((1.567867, 0.253958), abs=1e-6)
    assert tuple(Z.size_quantiles(df, ["id"]).first())[1:] == pytest.approx((0.036, 0.09, 1.7, 1.94, 2.0))


def test_frequency_quantiles(spark):
    df = spark.createDataFrame([(1, k, n) for k, n in ((0, 50), (1, 30), (2, 15), (5, 5))], "id int, frequency int, npixels long")
    assert tuple(Z.frequency_nearest(df, ["id"], 9).first())[1:] == (0, 0, 2, 5)
    assert tuple(Z.frequency_smoothed(df, ["id"], 9).first())[1:] == pytest.approx((0, 0, 4.0, 4.8))


def test_return_interval_leaves_out_or_counts_years_without_fire(spark):
    df = spark.createDataFrame([(1, "1995-1998", 1.0, 10.0), (1, "1995-1998", 3.0, 10.0)], "id int, period string, area double, flammable double")
    years = lambda p: F.lit(4)
    assert Z.return_interval(df, years).first()["perc_ba"] == pytest.approx(0.2)
    assert Z.return_interval(df, years, zero_fill=True).first()["perc_ba"] == pytest.approx(0.1)


def test_water_deficit(spark):
    p = [200, 180, 150, 60, 20, 5, 0, 10, 40, 90, 150, 190]
    e = [100, 95, 100, 90, 70, 50, 30, 30, 40, 60, 90, 100]
    rows = [(1, 2000 + y, m + 1, float(p[m]), float(e[m])) for y in range(2) for m in range(12)] + [(1, 2002, m, 500.0 if m == 1 else 1.0, 1.0) for m in range(1, 7)]
    df = spark.createDataFrame(rows, "id int, year int, month int, prec double, aet double")
    got = C.water_deficit(df, 2000, 2002)
    assert [r["cwd"] for r in got.where("climate_year = 2000").orderBy("k").collect()] == [0, 0, 0, -30, -80, -125, -155, -175, -175, -145, -85, 0]
    assert sorted({r["climate_year"] for r in got.collect()}) == [2000, 2001]
    top = C.max_deficit(got).where("climate_year = 2000").first()
    assert (top["mcwd"], top["mcwd_year"], top["mcwd_month"], top["cwd_length"]) == (-175, 2000, 8, 5)


def test_single_wettest_month_and_relabelled_deficit(spark):
    rows = [(1, 2000, 1, 10.0), (1, 2001, 1, 10.0), (1, 2000, 3, 0.0), (1, 2001, 3, 15.0), (1, 2001, 9, 15.0)]
    df = spark.createDataFrame(rows, "id int, year int, month int, prec double")
    assert (C.wettest_month(df).first()["wettest"], C.wettest_month(df, single=True).first()["wettest"]) == (9, 3)
    assert C.wettest_month(df.where("month < 9")).first()["wettest"] == 1
    assert C.wettest_month(df.limit(0), single=True).count() == 0
    mcwd = spark.createDataFrame([(1, 2000, 11), (1, 2001, 12), (1, 2002, 1), (2, 2000, 4), (2, 2001, None)], "id int, climate_year int, mcwd_month int")
    found = {(r["id"], r["climate_year"]): r["peak_rel"] for r in C.relabelled_deficit(mcwd).collect()}
    assert found == {(1, 2000): 9.0, (1, 2001): 10.0, (1, 2002): 11.0, (2, 2000): 6.0, (2, 2001): None}


def brute_components(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components(spark, pairs):
    got = {r["node"]: r["label"] for r in G.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    links = [(a, b) for a, b in pairs if a != b]
    assert got == brute_components({x for p in links for x in p}, links)


def test_long_chain_settles(spark):
    got = G.components(spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.where("label <> 0").count() == 0 and got.count() == 301


def test_neighbour_fill_goes_on_over_gaps_and_keeps_the_unreachable(spark):
    values = spark.createDataFrame([(0, 4.0), (1, None), (2, None), (3, None), (9, None)], "id int, v double")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src int, dst int")
    assert {r["id"]: r["v"] for r in G.neighbour_fill(values, edges, "v").collect()} == {0: 4.0, 1: 4.0, 2: 4.0, 3: 4.0, 9: None}


def test_consecutive_months_carry_the_newer_month(spark):
    # Month 7 touches only month 5's part of the group that month 6 made its own.
    rows = [(2000, 5, 1, 0, 0), (2000, 6, 2, 0, 1), (2000, 7, 3, 1, -1), (2000, 9, 4, 9, 9)]
    df = spark.createDataFrame(rows, "year int, month int, px long, row int, col int")
    got = {r["px"]: (r["month"], r["fire"]) for r in G.merge_consecutive_months(df, 1.5, range(5, 10)).collect()}
    assert got[1] == got[2] == got[3] and got[1][0] == 7 and got[4][0] == 9 and got[4][1] != got[1][1]


def swept(rows, radius, months):
    """The sweep by sets of pixels: year -> groups of (month, pixels)."""
    near = lambda p, q: (p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2 <= radius * radius
    out = {}
    for year in {r[0] for r in rows}:
        groups = [(r[1], [r]) for r in rows if r[0] == year]
        for m in months:
            held, rest = [g for g in groups if g[0] in (m - 1, m)], [g for g in groups if g[0] not in (m - 1, m)]
            merged = []
            while held:
                now, first, grew = [held.pop()], True, True
                while grew:
                    grew = [g for g in held if any(near(p, q) for _, ps in now for p in ps for q in g[1])]
                    held = [g for g in held if g not in grew]
                    now += grew
                merged.append((max(g[0] for g in now), [p for g in now for p in g[1]]))
            groups = rest + merged
        for month, pixels in groups:
            least = min((p[1], p[2]) for p in pixels)
            out |= {(year, p[2]): (p[1], month, *least) for p in pixels}
    return out


@pytest.mark.parametrize(("most", "tile"), [(200_000, 256), (3, 4)])
def test_consecutive_months_against_sets_of_pixels(spark, most, tile):
    draw = np.random.default_rng(9)
    rows = []
    for year in (1999, 2000):
        for k in draw.permutation(14 * 14)[:90]:
            rows.append((year, int(draw.integers(2, 8)), int(k) - 50 + 2 * 10**12, int(k) // 14 - 5, int(k) % 14 - 5))
    df = spark.createDataFrame(rows, "year int, month int, px long, row int, col int")
    got = {(r["year"], r["px"]): (r["month0"], r["month"], r["fire_month"], r["fire"]) for r in G.merge_consecutive_months(df, 1.5, range(2, 8), tile, most).collect()}
    assert got == swept(rows, 1.5, range(2, 8))


def test_wide_pixel_numbers_stay_apart(spark):
    rows = [(2000, 1, 10**12 + 1, 0, 0), (2000, 1, 10**12 + 2, 900, 900), (2000, 1, -5, 0, 1), (2000, 1, -40, 0, 2)]
    df = spark.createDataFrame(rows, "year int, month int, px long, row int, col int")
    assert {r["px"]: r["fire"] for r in G.merge_same_month(df, 1.5, tile=2).collect()} == {10**12 + 1: -40, -5: -40, -40: -40, 10**12 + 2: 10**12 + 2}
    patches = R.label_patches(df.withColumn("value", F.lit(1)), ["year"], tile=2)
    assert {r["px"]: r["patch"] for r in patches.collect()} == {10**12 + 1: -40, -5: -40, -40: -40, 10**12 + 2: 10**12 + 2}


@pytest.mark.parametrize("tile", [1, 3, 100])
def test_patches_do_not_depend_on_tiles(spark, tile):
    grid = np.random.default_rng(3).integers(0, 2, (9, 11))
    rows = [(1, int(r * 11 + c), int(r), int(c), int(grid[r, c])) for r in range(9) for c in range(11)]
    links = [(a[1], b[1]) for a in rows for b in rows if a[4] == b[4] and max(abs(a[2] - b[2]), abs(a[3] - b[3])) == 1]
    got = R.label_patches(spark.createDataFrame(rows, "scene int, px long, row int, col int, value int"), ["scene"], tile)
    assert {r["px"]: r["patch"] for r in got.collect()} == brute_components([r[1] for r in rows], links)


def test_clip_and_area():
    square, triangle = [(0, 0), (2, 0), (2, 2), (0, 2)], [(1, 1), (3, 1), (1, 3)]
    assert abs(X.shoelace(X.clip(triangle, square))) == pytest.approx(1.0)
    assert X.clip([(5, 5), (6, 5), (5, 6)], square) == []
    assert X.centroid(square) == pytest.approx((1, 1))


def test_spatial_join_makes_each_pair_once(spark):
    ring = lambda x, y, s: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s))]
    kind = "array<struct<x:double,y:double>>"
    a = spark.createDataFrame([(1, ring(0, 0, 10)), (2, ring(50, 50, 1))], f"a_id int, a_ring {kind}")
    b = spark.createDataFrame([(1, ring(3, 3, 4)), (2, ring(9, 9, 5)), (3, ring(20, 20, 1))], f"b_id int, b_ring {kind}")
    assert sorted((r["a_id"], r["b_id"]) for r in X.spatial_join(a, b, 2.0).collect()) == [(1, 1), (1, 2)]


def test_bhattacharyya_and_ellipsoid():
    assert M.bhattacharyya([0, 0], np.eye(2), [1, 0], np.eye(2)) == pytest.approx(0.125)
    centre, m = M.ellipsoid(np.array([(1, 0), (-1, 0), (0, 2), (0, -2)], float), 1e-6)
    assert centre == pytest.approx([0, 0], abs=1e-3) and np.diag(m) == pytest.approx([1, 0.25], abs=1e-2)


def test_pca_is_numpys(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet").select(*[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(3)])
    scored, values, _ = M.pca(df, ["e0", "e1", "e2"])
    x = np.array(df.collect())
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert values == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1])
    assert np.var([r["PC1"] for r in scored.select("PC1").collect()], ddof=1) == pytest.approx(values[0])


def test_constrained_ward_joins_neighbours_only():
    points = np.array([[0.0], [0.1], [5.0], [0.0]])
    assert M.constrained_ward(points, np.array([(0, 1), (1, 2), (2, 3)]), 3).tolist() == [0, 0, 1, 2]


def test_streams_give_the_batch_result(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "user_id", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = I.tumbling(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r["start"], r["event_type"], round(r["total"], 6), r["n"]) for r in df.collect())
    assert key(spark.table("days")) == key(I.tumbling(events))


def test_late_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    schema = "ts timestamp, user_id long, event_type string, value double"
    for k, day in enumerate(("2024-01-01 10:00:00", "2024-01-09 10:00:00", "2024-01-01 11:00:00")):
        spark.sql(f"SELECT timestamp'{day}' AS ts, 1L AS user_id, 'a' AS event_type, 1.0D AS value").coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
        stream = I.tumbling(spark.readStream.schema(schema).parquet(str(tmp_path / "in/part=*")), late="1 day")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_state_per_user(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "user_id", "event_type", "value")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    last: dict = {}

    def take(df, _):
        last.update({r["user_id"]: r["n"] for r in df.collect()})

    stream = I.running_months(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    stream.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert last == {r["user_id"]: r["count"] for r in events.groupBy("user_id").count().collect()}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    key = lambda d: sorted(r["id"] for r in T.sample_rows(d, 20, 3, "id").collect())
    assert key(df) == key(df.repartition(7)) != sorted(r["id"] for r in T.sample_rows(df, 20, 4, "id").collect())


def test_assembly(spark):
    a = spark.createDataFrame([(1, "x", 2.0), (2, "y", 3.0)], "id int, cls string, v double")
    b = spark.createDataFrame([(1, 5)], "id int, w int")
    out = T.flip_sign(T.recode(T.assemble(T.existing(a, ["v", "id", "cls", "none"]), [b], ["id"], "left"), "cls", {"x": "wet"}, "dry"), "v", F.col("id") == 2)
    assert sorted(tuple(r) for r in out.select("id", "cls", "v", "w").collect()) == [(1, "wet", 2.0, 5), (2, "dry", -3.0, None)]


def test_first_part_wins(spark):
    a = spark.createDataFrame([(1, 10)], "k int, v int")
    b = spark.createDataFrame([(1, 20), (2, 30)], "k int, v int")
    assert sorted(tuple(r) for r in T.first_wins([a, b], ["k"]).collect()) == [(1, 10), (2, 30)]


def test_cell_filter_applies_every_rule(spark):
    df, grid = spark.createDataFrame([(i,) for i in range(5)], "id int"), spark.createDataFrame([(i, 20.0 * i) for i in range(5)], "id int, pct_area double")
    ids = lambda **k: sorted(r["id"] for r in T.cell_filter(df, grid, 50, **k).collect())
    assert ids() == [3, 4] and ids(include=[0]) == [0, 3, 4] and ids(exclude=[3]) == [4] and ids(include=[0, 1], exclude=[1, 4]) == [0, 3]


def test_least_ellipsoids(spark):
    from cinderlake.operators import multivariate as M

    square = np.array([[0, 0], [0, 2], [2, 0], [2, 2], [1, 1], [0.5, 1]], float)
    centre, matrix = M.ellipsoid(square)
    assert centre == pytest.approx([1, 1], abs=1e-4) and matrix == pytest.approx(np.eye(2) / 2, abs=1e-4)
    assert M.ellipsoid_volume(np.eye(2) / 2, 4) == pytest.approx(0.8**-4 * 2)
    with pytest.raises(ValueError, match="plane"):
        M.ellipsoid(np.array([[0, 0], [1, 1], [2, 2]], float))
    draw = np.random.default_rng(3)
    clouds = {k: draw.normal(k, 1 + k, (200, 3)) @ draw.normal(0, 1, (3, 3)) for k in range(3)}
    rows = [(k, *map(float, p)) for k, x in clouds.items() for p in x] + [(9, 1.0, 2.0, 3.0)] * 5
    df = spark.createDataFrame(rows, "label int, x double, y double, z double")
    got = {r["label"]: r for r in M.volumes(df, "label", ["x", "y", "z"]).collect()}
    for k, x in clouds.items():
        c, m = M.ellipsoid(x, 1e-8)
        assert (np.einsum("ij,jk,ik->i", x - c, m, x - c) <= 1 + 1e-6).all()
        assert got[k]["volume"] == pytest.approx(M.ellipsoid_volume(m, 200), rel=1e-3)
    assert got[9]["volume"] is None and got[9]["n"] == 5
    merged = {(r["a"], r["b"]): r for r in M.merges(df, "label", ["x", "y", "z"], [(0, 1), (1, 9)]).collect()}
    both = M.ellipsoid(np.vstack([clouds[0], clouds[1]]), 1e-8)[1]
    volume = sum(M.ellipsoid_volume(M.ellipsoid(clouds[k], 1e-8)[1], 200) for k in (0, 1)) / M.ellipsoid_volume(both, 400)
    c, m = M.ellipsoid(clouds[1], 1e-8)
    inside = (np.einsum("ij,jk,ik->i", clouds[0] - c, m, clouds[0] - c) <= 1.5).mean()
    assert merged[0, 1]["by_volume"] == (volume > 1) and merged[0, 1]["inside"] == pytest.approx(inside) and merged[0, 1]["merge"] == (volume > 1 or inside >= 0.3)


def test_relations_of_rings():
    from cinderlake.operators.geometry import A_OUT, B_OUT, INSIDE, MEET, relate

    ell = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
    cases = {
        ((2, 2), (3, 2), (3, 3), (2, 3)): A_OUT | B_OUT,  # in the notch: bounds meet, rings do not
        ((1, 1), (3, 1), (3, 3), (1, 3)): MEET | A_OUT | B_OUT,  # fills the notch, edges in common
        ((4, 1), (5, 1), (5, 2), (4, 2)): MEET | A_OUT | B_OUT,  # a corner in common
        ((0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8)): INSIDE | A_OUT,
        ((0, 0), (0, 1), (1, 1), (1, 0)): MEET | INSIDE | A_OUT,
        ((-1, -1), (5, -1), (5, 5), (-1, 5)): INSIDE | B_OUT,
        ((0.5, 0.5), (3, 0.5), (3, 3)): MEET | INSIDE | A_OUT | B_OUT,
        tuple(ell[::-1]): MEET | INSIDE,
    }
    for ring, want in cases.items():
        assert relate(ell, list(ring)) == want, ring


def test_distances_on_the_ellipsoid(spark):
    from cinderlake.operators import graph as G

    at = [(0.0, 0.0, 0.0, 1.0, 110.574), (0.0, 0.0, 1.0, 0.0, 111.320), (-50.0, -10.0, -49.5, -10.5, None), (3.0, 4.0, 3.0, 4.0, 0.0)]
    df = spark.createDataFrame(at, "a double, b double, c double, d double, want double")
    for r in df.withColumn("km", G.geodesic_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect():
        assert r["want"] is None or r["km"] == pytest.approx(r["want"], abs=2e-3)


def test_merges_across_tiles(spark):
    from cinderlake.operators import graph as G

    draw = np.random.default_rng(7)
    cells = sorted({(int(y), int(r), int(c)) for y, r, c in zip(draw.integers(0, 2, 500), draw.integers(0, 40, 500), draw.integers(0, 40, 500), strict=True)})
    rows = [(y, 1, r * 40 + c, r, c) for y, r, c in cells]
    df = spark.createDataFrame(rows, "year int, month int, px long, row long, col long")
    got = {(r["year"], r["px"]): r["fire"] for r in G.merge_same_month(df, 2.3, tile=8).collect()}
    root = {(y, px): (y, px) for y, _, px, _, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, p in enumerate(rows):
        for q in rows[:i]:
            if p[0] == q[0] and (p[3] - q[3]) ** 2 + (p[4] - q[4]) ** 2 <= 2.3**2:
                a, b = find((p[0], p[2])), find((q[0], q[2]))
                root[max(a, b)] = min(a, b)
    assert got == {k: find(k)[1] for k in root}


def test_student_tail():
    for t, degrees, p in ((2.0, 10, 0.073388), (-1.812461, 10, 0.1), (3.0, 1, 0.204833), (1.959964, 1e7, 0.05), (0.0, 5, 1.0)):
        assert M.t_tail(t, degrees) == pytest.approx(p, abs=2e-6)


def test_correlations_mark_what_is_significant(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    df = spark.createDataFrame([(a, 2 * a, b, None) for a, b in zip(x, [2.0, 1.0, 4.0, 3.0, 6.0, 5.0], strict=True)] + [(None, 1.0, 1.0, None)], "x double, y double, z double, w double")
    got = {(r["a"], r["b"]): r for r in M.correlations(df, ["x", "y", "z", "w"]).collect()}
    assert got["x", "y"]["p"] < 1e-9 and got["x", "y"]["stars"] == "***" and got["x", "y"]["n"] == 6
    r = np.corrcoef(x, [2, 1, 4, 3, 6, 5])[0, 1]
    assert got["x", "z"]["r"] == pytest.approx(r) and got["x", "z"]["p"] == pytest.approx(0.0415627, abs=1e-5) and got["x", "z"]["stars"] == "*"
    assert got["x", "w"]["p"] is None and got["x", "w"]["stars"] == "" and got["x", "w"]["n"] == 0


def _classes(spark):
    rng = np.random.default_rng(3)
    label = np.repeat([0, 1, 2], [40, 25, 10])
    x = rng.normal(size=(75, 2)) + np.array([[0, 0], [2, 1], [0, 3]])[label]
    return label, x, spark.createDataFrame([(i, int(c), float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(label, x, strict=True))], "id long, label int, a double, b double")


def test_calinski_harabasz_and_widths_by_hand(spark):
    label, x, df = _classes(spark)
    means = np.array([x[label == k].mean(0) for k in range(3)])
    within = ((x - means[label]) ** 2).sum()
    between = ((means[label] - x.mean(0)) ** 2).sum()
    got = M.calinski_harabasz(df, "label", ["a", "b"]).first()
    assert (got["n"], got["k"]) == (75, 3) and got["ch"] == pytest.approx(between / 2 / (within / 72))
    assert M.calinski_harabasz(df.where("label = 0"), "label", ["a", "b"]).first()["ch"] is None
    two = df.withColumn("two", F.least("label", F.lit(1)))
    got = {r["partition"]: (r["k"], r["width"]) for r in M.mean_widths(two, ["label", "two"], ["a", "b"]).collect()}
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for name, own in (("label", label), ("two", np.minimum(label, 1))):
        widths = []
        for i in range(75):
            mean = {k: distance[i, own == k].sum() / ((own == k).sum() - (k == own[i])) for k in set(own)}
            inner, outer = mean.pop(own[i]), min(mean.values() if own[i] not in mean else [])
            widths.append((outer - inner) / max(inner, outer))
        assert got[name] == (len(set(own)), pytest.approx(np.mean(widths)))


def test_discriminant_rule_by_numpy(spark):
    label, x, df = _classes(spark)
    means, shares = np.array([x[label == k].mean(0) for k in range(3)]), np.bincount(label) / 75
    within = sum(((x[label == k] - means[k]).T @ (x[label == k] - means[k])) for k in range(3)) / 72
    w = np.linalg.solve(within, means.T)
    best = (x @ w - (means.T * w).sum(0) / 2 + np.log(shares)).argmax(1)
    got = {r["label"]: (r["n"], r["accuracy"]) for r in M.discriminant_accuracy(df, "label", ["a", "b"]).collect()}
    assert got == {k: ((label == k).sum(), pytest.approx((best == label)[label == k].mean())) for k in range(3)}


def test_partial_redundancy_by_least_squares(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "y1 double, y2 double, x1 double, x2 double, g double")
    fitted = lambda cols: z[:, cols] @ np.linalg.lstsq(z[:, cols], z[:, :2], rcond=None)[0]
    r2_of = lambda cols: (fitted(cols) ** 2).sum() / (z[:, :2] ** 2).sum()
    adjusted = lambda cols: 1 - (1 - r2_of(cols)) * 59 / (59 - len(cols))
    values, axes, coefficients, r2, adj = M.ordination(df, ["y1", "y2"], ["x1", "x2"], ["g"])
    assert r2 == pytest.approx(r2_of([2, 3, 4]) - r2_of([4])) and adj == pytest.approx(adjusted([2, 3, 4]) - adjusted([4]))
    assert values == pytest.approx(np.linalg.eigvalsh(np.cov((fitted([2, 3, 4]) - fitted([4])).T))[::-1])
    assert coefficients == pytest.approx(np.linalg.lstsq(z[:, 2:], z[:, :2], rcond=None)[0][:2])
    assert M.redundancy(df, ["y1", "y2"], ["x1", "x2", "g"])[0] == pytest.approx(r2_of([2, 3, 4]))


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 9), st.integers(1, 4), st.integers(0, 10_000))
def test_constrained_ward_by_brute_force(n, k, seed):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, 2))
    edges = np.array([(a, b) for a in range(n) for b in range(a) if rng.random() < 0.4], int).reshape(-1, 2)
    groups, heights = [[i] for i in range(n)], []
    while len(groups) > k:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                if any((a in groups[i]) != (a in groups[j]) and {a, b} <= set(groups[i] + groups[j]) and (a in groups[i]) != (b in groups[i]) for a, b in edges):
                    p, q = points[groups[i]], points[groups[j]]
                    cost = len(p) * len(q) / (len(p) + len(q)) * ((p.mean(0) - q.mean(0)) ** 2).sum()
                    best = min(best or (np.inf,), (cost, i, j))
        if best is None:
            break
        heights.append(best[0])
        groups[best[1]] += groups.pop(best[2])
    found: list[float] = []
    labels = M.constrained_ward(points, edges, k, found)
    assert {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels.tolist())} == {frozenset(g) for g in groups}
    assert found == pytest.approx(heights)


def test_quantiles_singletons_density_and_lists(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0), ("b", None), (None, 2.0)], "k string, v double")
    got = {r["k"]: (r["q"], r["top"]) for r in T.quantiles_by(df, ["k"], "v", {"q": 0.75, "top": 1.0}).collect()}
    assert got == {"a": (2.5, 4.0), "b": (None, None), None: (2.0, 2.0)}
    assert sorted((str(r["k"]), r["single"]) for r in T.singletons(df, ["k"]).collect()) == [("None", True), ("a", False), ("a", False), ("a", False), ("b", True)]
    assert [r["density"] for r in T.density(spark.createDataFrame([(4, 2.0), (4, 0.0), (4, None)], "n int, area double"), "n", "area").collect()] == [2.0, None, None]
    lists = T.class_table(spark, {"x": [1, 2], "y": [2]})
    px = spark.createDataFrame([(1,), (2,), (3,)], "cls int")
    assert sorted(map(tuple, T.by_class_list(px, "cls", lists).select("cls", "list").collect())) == [(1, "x"), (2, "x"), (2, "y")]
    assert sorted(map(tuple, T.by_class_list(px, "cls", lists, "other").select("cls", "list").collect())) == [(1, "x"), (2, "x"), (2, "y"), (3, "other")]


def test_vintages_and_frequencies_over_the_most(spark):
    one = spark.createDataFrame([("1100015", 1.0, "n")], "code string, area double, name string")
    two = spark.createDataFrame([("1100015", 2.0, "m"), ("1100015", 3.0, "k")], "geo string, area double, name string")
    got = T.harmonise_vintages({2000: one, 2010: two}, {2010: {"geo": "code"}}, "code", {}, ["m_code", "s_code", "area", "name"])
    assert sorted((r["vintage"], r["m_code"], r["area"], r["name"]) for r in got.collect()) == [(2000, "110001", 1.0, "n"), (2010, "110001", 5.0, "k")]
    freq = spark.createDataFrame([(1, 2, 5), (1, 9, 1)], "id int, frequency long, npixels long")
    assert Z.frequency_nearest(freq, ["id"], 9).first()["f50"] == 2
    with pytest.raises(Exception, match="a frequency is over 7"):
        Z.frequency_nearest(freq, ["id"], 7).collect()


def test_geodesics_at_full_precision(spark):
    # Published test lines of the ellipsoid: most to a millimetre, and an antipodal pair.
    lines = [(0.0, 0.0, 0.5, 0.5, 78.451249), (144.42486788888888, -37.95103341666667, 143.92649552777777, -37.65282113888889, 54.972271), (-73.8, 40.6, -0.5, 51.6, 5551.7594), (0.0, 0.0, 179.9, 0.1, None), (10.0, 20.0, 10.0, 20.0, 0.0), (0.0, 0.0, 90.0, 0.0, 10018.754171), (0.0, 0.0, 0.0, 90.0, 10001.965729), (179.5, 10.0, -179.5, 10.0, 109.6393)]
    df = spark.createDataFrame(lines, "a double, b double, c double, d double, want double")
    for r in df.withColumn("g", G.geodesic(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect():
        if r["want"] is None:
            assert not r["g"]["converged"] and r["g"]["km"] is None
        else:
            assert r["g"]["converged"] and r["g"]["km"] == pytest.approx(r["want"], abs={109.6393: 1e-4}.get(r["want"], 1e-6))


def test_terrain_at_borders_is_extrapolated(spark):
    plane = [(1, r, c, 2.0 * c + 3.0 * r) for r in range(5) for c in range(4)]
    got = {(r["row"], r["col"]): r for r in R.terrain(spark.createDataFrame(plane, "s int, row int, col int, value double"), ["s"]).collect()}
    assert len(got) == 20 and all(r["slope"] is not None for r in got.values())
    for (r, c), x in got.items():
        corner = r in (0, 4) and c in (0, 3)
        assert x["slope"] == pytest.approx(np.degrees(np.arctan(np.hypot(1.0 if corner else 2.0, 3.0))))
    one = R.terrain(spark.createDataFrame([(1, 0, 0, 7.0)], "s int, row int, col int, value double"), ["s"]).first()
    assert (one["roughness"], one["tri"], one["slope"]) == (0, 0, 0)


def ordination_by_rows(y, x, w, scaling):
    standard = lambda m: (m - m.mean(0)) / m.std(0, ddof=1)
    y, x = standard(y), standard(x)
    given = standard(w) @ np.linalg.lstsq(standard(w), y, rcond=None)[0] if w is not None else np.zeros_like(y)
    both = np.hstack([x, standard(w)]) if w is not None else x
    fitted = both @ np.linalg.lstsq(both, y, rcond=None)[0]
    out = {}
    for prefix, base, rows in (("fit", fitted - given, fitted - given), ("site", fitted - given, y - given), ("res", y - fitted, y - fitted)):
        values, vectors = np.linalg.eigh(base.T @ base / (len(y) - 1))
        for k in range(y.shape[1] if prefix == "res" else min(y.shape[1], x.shape[1])):
            out[f"{prefix}{k + 1}"] = rows @ vectors[:, -1 - k] / (np.sqrt(values[-1 - k]) if scaling == 2 else 1)
    return out


@pytest.mark.parametrize("scaling", [1, 2])
@pytest.mark.parametrize("given", [(), ("g",)])
def test_ordination_scores_against_regressions(spark, scaling, given):
    draw = np.random.default_rng(8)
    m = draw.normal(size=(40, 6)) @ draw.normal(size=(6, 6))
    df = spark.createDataFrame(m.tolist(), "y1 double, y2 double, y3 double, x1 double, x2 double, g double")
    got = M.ordination_scores(df, ["y1", "y2", "y3"], ["x1", "x2"], given, scaling).toPandas()
    want = ordination_by_rows(m[:, :3], m[:, 3:5], m[:, 5:] if given else None, scaling)
    assert {c for c in got.columns if c[:3] in ("fit", "sit", "res")} == set(want)
    for c, v in want.items():
        own = got[c].to_numpy()
        assert np.allclose(own * np.sign(own @ v), v, atol=1e-8)


def test_biplot_and_discriminant_scores(spark):
    draw = np.random.default_rng(9)
    m = draw.normal(size=(30, 3)) @ draw.normal(size=(3, 3))
    df = spark.createDataFrame([(*row, k % 3) for k, row in enumerate(m.tolist())], "a double, b double, c double, label int")
    scores, values, vectors = M.pca(df, ["a", "b", "c"])
    z = (m - m.mean(0)) / m.std(0, ddof=1)
    for scaling in (1, 2):
        sites, variables = M.biplot(scores, ["a", "b", "c"], values, vectors, 30, scaling)
        own = sites.select("PC1", "PC2", "PC3").toPandas().to_numpy()
        assert np.allclose(own @ variables.T, z, atol=1e-8)  # rows times variables give the data back in both scalings
        if scaling == 2:
            assert np.allclose(variables @ variables.T, np.corrcoef(m.T)) and np.allclose(own.var(0, ddof=1), 1)
    ld = M.discriminant_scores(df, "label", ["a", "b", "c"]).toPandas()
    groups = [ld[ld.label == k][["LD1", "LD2"]].to_numpy() for k in range(3)]
    within = sum((g - g.mean(0)).T @ (g - g.mean(0)) for g in groups) / (30 - 3)
    assert np.allclose(within, np.eye(2), atol=1e-8) and np.allclose(ld[["LD1", "LD2"]].mean(), 0, atol=1e-8)


@pytest.mark.parametrize("block", [20, 5000])
def test_dunn_against_all_distances(spark, block):
    draw = np.random.default_rng(10)
    x = np.concatenate([draw.normal(size=(700, 3)) * (1, 0.3, 0.2) + at for at in ((0, 0, 0), (6, 1, 0), (0, 5, 4))])
    y = np.repeat([1, 2, 3], 700)
    rows = [(int(k), *map(float, v)) for k, v in zip(y, x, strict=True)]
    df = spark.createDataFrame(rows + rows[:50] + [(None, 0.0, 0.0, 0.0)], "label int, a double, b double, c double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    same = y[:, None] == y[None]
    got = M.dunn(df, "label", ["a", "b", "c"], block).first()
    assert got["separation"] == pytest.approx(d[~same].min()) and got["diameter"] == pytest.approx(d[same].max())
    assert got["dunn"] == pytest.approx(d[~same].min() / d[same].max())
    assert block > 2000 or got["visits"] < 0.05 * 2100**2 / 2


def test_dunn_of_small_tables(spark):
    of = lambda rows: M.dunn(spark.createDataFrame(rows, "label int, a double, b double"), "label", ["a", "b"])
    assert of([]).count() == 0
    assert tuple(of([(1, 0.0, 0.0), (1, 3.0, 4.0)]).first())[:3] == (None, 5.0, None)
    assert tuple(of([(1, 0.0, 0.0), (2, 3.0, 4.0)]).first())[:3] == (5.0, 0.0, None)
