"""Grid neighbours, components, merges in space and time, and imputation over neighbours."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.functions.storage import discard, materialise

FORWARD = ((0, 1), (1, -1), (1, 0), (1, 1))
#: Rows of labels that a join of components may send to all tasks, by way of the driver; more are joined by merge.
SENT = 20_000
AROUND = tuple((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0))


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """node, label (the smallest node of its component) for all nodes in links (a, b).

    A round gives each node the smallest label around it and then that label's label, so paths shorten by half or
    more each time; every round is a written table. A hot node's neighbours are met by a join that can be split and
    a minimum with map-side combine.
    """
    both = links.where("a <> b")
    edges = materialise(both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    merged = (lambda df: df.hint("merge")) if labels.count() > SENT else (lambda df: df)
    for _ in range(max_rounds):
        near = edges.join(merged(labels.select(F.col("node").alias("b"), "label")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = materialise(labels.join(merged(near), "node").select("node", "label", F.least("label", "near").alias("via")), "met")
        jump = met.select(F.col("node").alias("via"), F.col("via").alias("next"))
        new = materialise(met.join(merged(jump), "via").select("node", F.col("label").alias("old"), F.least("via", "next").alias("label")), "labels")
        discard(met, labels)
        labels = new.drop("old")
        labels._table_path = new._table_path
        if new.where("old <> label").isEmpty():
            discard(edges)
            out = merged(labels)
            out._table_path = labels._table_path
            return out
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def label_all(nodes: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """nodes with label; a node without links is its own."""
    found = components(links).withColumnRenamed("node", node)
    return nodes.join(found, node, "left").withColumn("label", F.coalesce("label", node))


def neighbours(cells: DataFrame, keys: Sequence[str] = (), offsets=FORWARD, node: str = "id") -> DataFrame:
    """Pairs src, dst of cells (row, col) at one of the offsets, within equal keys: an equi-join, no distances."""
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets])
    out = cells.select(*keys, F.col(node).alias("src"), "row", "col", F.explode(steps).alias("s")).select(*keys, "src", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    return out.join(cells.select(*keys, F.col(node).alias("dst"), "row", "col"), [*keys, "row", "col"]).select(*keys, "src", "dst")


def discs(radius: float) -> tuple:
    """Forward offsets of pixels whose centres lie within radius."""
    n = int(radius)
    return tuple((r, c) for r in range(n + 1) for c in range(-n, n + 1) if (r, c) > (0, 0) and r * r + c * c <= radius * radius)


def geodesic_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on the WGS-84 ellipsoid by the Andoyer-Lambert formula: reduced latitudes on a sphere, corrected to first
    order in the flattening (some metres in 1,000 km; antipodal points are out of its range)."""
    radius, flat = 6378.137, 1 / 298.257223563
    b1, b2 = (F.atan((1 - flat) * F.tan(F.radians(lat))) for lat in (lat1, lat2))
    h = F.sin((b2 - b1) / 2) ** 2 + F.cos(b1) * F.cos(b2) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    s = 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - F.sin(s)) * (F.sin(p) * F.cos(q)) ** 2 / F.cos(s / 2) ** 2
    y = (s + F.sin(s)) * (F.cos(p) * F.sin(q)) ** 2 / F.sin(s / 2) ** 2
    return F.when(s == 0, 0.0).otherwise(radius * (s - flat / 2 * (x + y)))


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 40) -> Column:
    """Km and converged: distance on the WGS-84 ellipsoid by Vincenty's inverse iteration, to less than a millimetre.

    Nearly antipodal points do not converge; their distance is null. Each round carries the angle between the points'
    longitudes on the sphere; aggregate() runs the rounds inside the row."""
    major, flat = 6378.137, 1 / 298.257223563
    minor = major * (1 - flat)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    names = ("lam", "change", "ss", "cs", "sigma", "ca", "cm")

    def step(u1: Column, u2: Column, l: Column):
        def of_point(s):
            cs = F.sin(u1) * F.sin(u2) + F.cos(u1) * F.cos(u2) * F.cos(s)
            ss = F.hypot(F.cos(u2) * F.sin(s), F.cos(u1) * F.sin(u2) - F.sin(u1) * F.cos(u2) * F.cos(s))
            return F.struct(ss.alias("ss"), cs.alias("cs"), zero(F.try_divide(F.cos(u1) * F.cos(u2) * F.sin(s), ss)).alias("sa"))

        def of_angle(p):
            ca = 1 - p["sa"] * p["sa"]
            return F.struct(p.alias("p"), F.atan2(p["ss"], p["cs"]).alias("sigma"), ca.alias("ca"), zero(p["cs"] - F.try_divide(2 * F.sin(u1) * F.sin(u2), ca)).alias("cm"), (flat / 16 * ca * (4 + flat * (4 - 3 * ca))).alias("c"))

        def next_state(lam, a):
            p = a["p"]
            new = l + (1 - a["c"]) * flat * p["sa"] * (a["sigma"] + a["c"] * p["ss"] * (a["cm"] + a["c"] * p["cs"] * (2 * a["cm"] * a["cm"] - 1)))
            return _let(new, lambda n: F.struct(n.alias("lam"), F.abs(n - lam).alias("change"), p["ss"].alias("ss"), p["cs"].alias("cs"), a["sigma"].alias("sigma"), a["ca"].alias("ca"), a["cm"].alias("cm")))

        return lambda state, _: _let(of_point(state["lam"]), lambda p: _let(of_angle(p), lambda a: next_state(state["lam"], a)))

    def whole(x):
        begin = F.struct(*[(x["l"] if n == "lam" else F.lit(0.0)).alias(n) for n in names])
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, step(x["u1"], x["u2"], x["l"]), length)

    def length(s):
        z = s["ca"] * (major * major / (minor * minor) - 1)
        a, b = 1 + z / 16384 * (4096 + z * (-768 + z * (320 - 175 * z))), z / 1024 * (256 + z * (-128 + z * (74 - 47 * z)))
        ok = (s["change"] < 1e-11) & (F.abs(s["lam"]) <= math.pi)
        inner = lambda b: b * s["ss"] * (s["cm"] + b / 4 * (s["cs"] * (2 * s["cm"] * s["cm"] - 1) - b / 6 * s["cm"] * (4 * s["ss"] * s["ss"] - 3) * (4 * s["cm"] * s["cm"] - 3)))
        return F.struct(F.when(ok, minor * a * (s["sigma"] - _let(b, inner))).alias("km"), ok.alias("converged"))

    reduced = lambda lat: F.atan((1 - flat) * F.tan(F.radians(lat)))
    return _let(F.struct(reduced(lat1).alias("u1"), reduced(lat2).alias("u2"), F.radians(F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180).alias("l")), whole)


def sphere_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere of 6371.0088 km (up to 0.6 % from the ellipsoid)."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * F.asin(F.sqrt(a))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def neighbour_mean(values: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """Id and the mean of value over neighbours that have one."""
    return symmetric(edges).join(values.select(F.col("id").alias("dst"), value), "dst").groupBy(F.col("src").alias("id")).agg(F.avg(value).alias(f"{value}_near"))


def fill_rounds(values: DataFrame, edges: DataFrame, columns: Sequence[str], mean, keys: Sequence[str] = ()) -> DataFrame:
    """id, keys and columns of values: nulls become mean(column), an aggregate over the neighbours (edges of id) with equal keys,
    in rounds over the values before the round, until none changes.

    Only rows with a gap and their edges take part in a round; the others are written once and looked up."""
    node = ["id", *keys]
    gaps = [F.col(c).isNull() for c in columns]
    gap = reduce(lambda p, q: p | q, gaps)
    lacking = lambda df: df.agg(F.sum(sum(g.cast("long") for g in gaps))).first()[0] or 0
    ids = lambda df: df.select(F.col("id").alias("src"), *keys)
    whole = materialise(values.select(*node, *[F.col(c).cast("double").alias(c) for c in columns]), "fill")
    firm, state = whole.where(~gap), materialise(whole.where(gap), "fill-gaps")
    missing = lacking(state)
    wanted = materialise(symmetric(edges).join(ids(state), "src").select("src", "dst", *keys), "fill-edges") if missing else None
    met = wanted
    while missing:
        now = firm.unionByName(state).withColumnRenamed("id", "dst")
        near = met.join(now, ["dst", *keys]).groupBy(F.col("src").alias("id"), *keys).agg(*[mean(c).alias(f"{c}_near") for c in columns])
        new = materialise(state.join(near, node, "left").select(*node, *[F.coalesce(c, f"{c}_near").alias(c) for c in columns]), "fill-gaps")
        discard(state)
        state = new
        left = lacking(state)
        if left == missing:
            break
        missing = left
        met = wanted.join(ids(state.where(gap)), ["src", *keys])
    if wanted is not None:
        discard(wanted)
    return firm.unionByName(state)


def neighbour_fill(values: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """Missing values become their neighbours' mean, again and again until none changes.

    All cells of a round see the values before it, so the result does not depend on row order. Cells that no value can
    reach stay null.
    """
    return fill_rounds(values, edges, [value], F.avg)


def low_count_impute(values: DataFrame, edges: DataFrame, count: str, columns: Sequence[str], least: int, rounded: Sequence[str] = ()) -> DataFrame:
    """Cells with at most least rows take the mean of neighbours with more; cells without such neighbours go."""
    rich = values.where(F.col(count) > least)
    near = symmetric(edges).join(rich.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*[F.avg(c).alias(c) for c in columns])
    near = near.withColumns({c: F.bround(c) for c in rounded})
    poor = values.where(F.col(count) <= least).select("id", count).join(near, "id").withColumn("imputed", F.lit(1))
    return rich.select("id", count, *columns).withColumn("imputed", F.lit(0)).unionByName(poor.select("id", count, *columns, "imputed"))


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number of each number's component, of 0 to n - 1 with links a, b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tile_labels(px: np.ndarray, row: np.ndarray, col: np.ndarray, offsets, value: np.ndarray | None = None) -> np.ndarray:
    """The least px of each pixel's component within one tile; pixels at one of the offsets, of equal value if given, are linked."""
    by = np.argsort(px, kind="stable")
    r, c = row[by] - row.min(), col[by] - col.min()
    width = int(c.max()) + 1 + 2 * max(abs(k) for _, k in offsets)
    code = r * width + c
    at = np.argsort(code, kind="stable")
    ordered = code[at]
    pairs = []
    for dr, dc in ((0, 0), *offsets):
        want = code + dr * width + dc
        i, z = np.searchsorted(ordered, want), np.searchsorted(ordered, want, side="right")
        for k in range(int((z - i).max())):  # several rows of one pixel
            here = np.flatnonzero(i + k < z)
            pairs.append((here, at[i[here] + k]))
    a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
    if value is not None:
        same = value[by][a] == value[by][b]
        a, b = a[same], b[same]
    label = _least(a, b, len(px))
    out = np.empty(len(px), np.int64)
    out[by] = px[by][label]
    return out


def merge_same_month(pixels: DataFrame, radius: float, keys: Sequence[str] = ("year", "month"), tile: int = 256) -> DataFrame:
    """Pixels of one month within radius of each other belong to one fire; label is its smallest pixel number.

    pixels: keys, px (unique within keys), row, col. Each tile of tile x tile pixels is labelled on its own; only pixels within
    radius of a tile's border look for neighbours in other tiles, and only labels that meet there go to components.
    """
    offsets, reach = discs(radius), int(radius)
    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}

    def one(part: pd.DataFrame) -> pd.DataFrame:
        row, col = part["row"].to_numpy(), part["col"].to_numpy()
        at = np.stack([row % tile, col % tile])
        edge = ((at < reach) | (at >= tile - reach)).any(0)
        return part.assign(local=tile_labels(part["px"].to_numpy(np.int64), row, col, offsets), edge=edge).drop(columns=["_tr", "_tc"])

    tiled = pixels.select(*keys, "px", "row", "col").withColumn("_tr", F.floor(F.col("row") / tile)).withColumn("_tc", F.floor(F.col("col") / tile))
    local = tiled.groupBy(*keys, "_tr", "_tc").applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "px", "row", "col"]) + ", local bigint, edge boolean")
    local = materialise(local.withColumn("_node", F.struct(*keys, "local")), "tiles")
    links = neighbours(local.where("edge").hint("merge"), keys, offsets, "_node").where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    met = label_all(local, links, "_node")
    return met.select(*keys, "px", "row", "col", F.col("label.local").alias("fire"))


def _sweep(links: pd.DataFrame, months: Sequence[int]) -> pd.DataFrame:
    """The forward sweep over the links (a_month, a_fire, b_month, b_fire) of some groups: their months and labels."""
    names = sorted({*zip(links.a_month, links.a_fire, strict=True), *zip(links.b_month, links.b_fire, strict=True)})
    at = {n: k for k, n in enumerate(names)}
    root, latest = list(range(len(names))), [m for m, _ in names]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by_month: dict[int, list[tuple[int, int]]] = {}
    for am, af, bm, bf in zip(links.a_month, links.a_fire, links.b_month, links.b_fire, strict=True):
        by_month.setdefault(bm, []).append((at[am, af], at[bm, bf]))
    for m in months:
        met = [(find(a), find(b)) for a, b in by_month.get(m, ()) if latest[find(a)] == m - 1]
        for a, b in met:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)  # names are in order, so a root is its group's least name
        for a, _ in met:
            latest[find(a)] = m
    ends = [find(i) for i in range(len(names))]
    return pd.DataFrame({"g_month": [m for m, _ in names], "g_fire": [f for _, f in names], "last": [latest[e] for e in ends], "fire_month": [names[e][0] for e in ends], "fire": [names[e][1] for e in ends]})


def _roots(links: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The groups (m, f) that links (a_month, a_fire, b_month, b_fire) join, each with the least of its connected set (rm, rf),
    and for each link the row of its first group."""
    n = len(links)
    m, f = (np.concatenate([links[f"{k}_{c}"].to_numpy(np.int64) for k in "ab"]) for c in ("month", "fire"))
    by = np.lexsort((f, m))
    new = np.append(True, (np.diff(m[by]) != 0) | (np.diff(f[by]) != 0))[: 2 * n]
    code = np.empty(2 * n, np.int64)
    code[by] = np.cumsum(new) - 1
    m, f = m[by][new], f[by][new]
    root = _least(code[:n], code[n:], len(m))
    return pd.DataFrame({"m": m, "f": f, "rm": m[root], "rf": f[root]}), code[:n]


def tile_links(part: pd.DataFrame, offsets) -> pd.DataFrame:
    """Links between groups of different months within one tile and to pixels around it, once each, with the least group of
    their connected set (rm, rf). part: month, fire, row, col, own."""
    row, col = (part[c].to_numpy(np.int64) - part[c].min() for c in ("row", "col"))
    month, fire, own = part["month"].to_numpy(), part["fire"].to_numpy(np.int64), np.flatnonzero(part["own"].to_numpy())
    width = int(col.max()) + 1 + 2 * max((abs(k) for _, k in offsets), default=0)
    code = row * width + col
    at = np.argsort(code, kind="stable")
    ordered = code[at]
    found = []
    for dr, dc in ((0, 0), *offsets):
        want = code[own] + dr * width + dc
        i, z = np.searchsorted(ordered, want), np.searchsorted(ordered, want, side="right")
        for k in range(int((z - i).max(initial=0))):  # several groups of one pixel
            here = np.flatnonzero(i + k < z)
            p, q = own[here], at[i[here] + k]
            p, q = p[apart := month[p] != month[q]], q[apart]
            found.append((np.where(month[p] < month[q], p, q), np.where(month[p] < month[q], q, p)))
    a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, int) for k in (0, 1))
    links = pd.DataFrame({"a_month": month[a], "a_fire": fire[a], "b_month": month[b], "b_fire": fire[b]}).drop_duplicates(ignore_index=True)
    groups, of = _roots(links)
    return links.assign(rm=groups["rm"].to_numpy()[of], rf=groups["rf"].to_numpy()[of])


def _roots_joined(stars: DataFrame, ends: DataFrame) -> DataFrame:
    """node, label of those least groups of tiles that groups of several tiles bring together.

    stars: year, m, f, rm, rf, of each tile; ends: year, m, f, lo and hi, the least and greatest (rm, rf) of each group."""
    name = lambda m, f: F.struct("year", F.col(m).alias("m"), F.col(f).alias("f"))
    shared = stars.join(ends.where("lo <> hi").select("year", "m", "f", "lo"), ["year", "m", "f"])
    return components(shared.select(name("lo.rm", "lo.rf").alias("a"), name("rm", "rf").alias("b")).where("a <> b").distinct())


def _ends(stars: DataFrame) -> DataFrame:
    root = F.struct("rm", "rf")
    return materialise(stars.groupBy("year", "m", "f").agg(F.min(root).alias("lo"), F.max(root).alias("hi")), "month-ends")


def _sweep_wide(links: DataFrame, months: Sequence[int]) -> DataFrame:
    """The same sweep as a few joins a month, for groups that are too many for one task.

    Only groups that count as the month before's are carried on; the rest keep what they have. A month's links are joined
    tile by tile first, so that only what several tiles share goes to components."""
    kinds = {f.name: f.dataType.simpleString() for f in links.schema.fields}
    tile = ["year", "tr", "tc"]
    schema = f"year {kinds['year']}, m {kinds['a_month']}, f bigint, rm {kinds['a_month']}, rf bigint"

    def one(part: pd.DataFrame) -> pd.DataFrame:
        return _roots(part)[0].assign(year=part["year"].iloc[0])[["year", "m", "f", "rm", "rf"]]

    ends = [links.select("year", F.col(f"{k}_month").alias("g_month"), F.col(f"{k}_fire").alias("g_fire")) for k in "ab"]
    groups = materialise(ends[0].union(ends[1]).distinct(), "sweep-groups")
    own = lambda m: groups.where(F.col("g_month") == m).select("*", F.struct("year", F.col("g_month").alias("m"), F.col("g_fire").alias("f")).alias("label"))
    done, carried, before = [], None, None
    for m in months:
        if before != m - 1:
            carried = own(m - 1)
        active = carried.select("year", F.col("g_month").alias("a_month"), F.col("g_fire").alias("a_fire"), F.col("label.m").alias("l_month"), F.col("label.f").alias("l_fire"))
        met = links.where(F.col("b_month") == m).join(active, ["year", "a_month", "a_fire"])
        met = met.select(*tile, F.col("l_month").alias("a_month"), F.col("l_fire").alias("a_fire"), "b_month", "b_fire")
        stars = materialise(met.groupBy(*tile).applyInPandas(one, schema), "sweep-tiles")
        lows = _ends(stars)
        roots = _roots_joined(stars, lows)
        low = F.struct("year", F.col("lo.rm").alias("m"), F.col("lo.rf").alias("f"))
        found = lows.select(F.struct("year", "m", "f").alias("of"), low.alias("node")).join(roots, "node", "left_outer").select("of", F.coalesce("label", "node").alias("joined"))
        state = carried.unionByName(own(m))
        state = materialise(state.join(found, F.col("label") == F.col("of"), "left").select("year", "g_month", "g_fire", "label", "joined"), "sweep")
        left = state.where((F.col("g_month") < m) & F.col("joined").isNull())
        done.append(left.select("year", "g_month", "g_fire", F.lit(m - 1).cast(kinds["a_month"]).alias("last"), "label"))
        carried = state.where((F.col("g_month") == m) | F.col("joined").isNotNull()).select("year", "g_month", "g_fire", F.coalesce("joined", "label").alias("label"))
        discard(stars, lows, roots)
        before = m
    if carried is not None:
        done.append(carried.select("year", "g_month", "g_fire", F.lit(before).cast(kinds["a_month"]).alias("last"), "label"))
    every = reduce(DataFrame.unionByName, done)
    return every.select("year", "g_month", "g_fire", "last", F.col("label.m").alias("fire_month"), F.col("label.f").alias("fire"))


def merge_consecutive_months(pixels: DataFrame, radius: float, months: Sequence[int] = tuple(range(1, 13)), tile: int = 256, most: int = 200_000) -> DataFrame:
    """Forward sweep over the months of a year. Groups of the month before join those of the month they touch and
    then count as that month's, so chains grow; groups left behind keep their last month.

    pixels: year, month, px, row, col. Returns year, px, month0 (burned), month (of its group), fire_month and fire (the least
    month of the group, and the least pixel of that month's first part).

    Pixels of one month become groups first (merge_same_month), as every month's groups are merged before they can meet others.
    Each tile, with the pixels around it, then gives the links between its groups of different months and the connected sets
    they make; what follows sees groups only, and only sets that share a group go to components. The sweep runs on connected
    sets: in one task each where a set has most links at most, else as joins month by month.
    """
    months, reach, offsets = sorted(months), int(radius), discs(radius)
    group = materialise(merge_same_month(pixels, radius, ("year", "month"), tile), "months")
    kinds = {f.name: f.dataType.simpleString() for f in group.schema.fields}
    over = lambda lo, hi: F.explode(F.sequence(F.floor(lo / tile), F.floor(hi / tile)))
    row, col = F.col("row"), F.col("col")
    sent = group.select("year", "month", "fire", "row", "col", over(row - reach, row).alias("tr")).withColumn("tc", over(col - reach, col + reach))
    sent = sent.withColumn("own", (F.col("tr") == F.floor(row / tile)) & (F.col("tc") == F.floor(col / tile)))
    names = {"year": kinds["year"], "tr": "bigint", "tc": "bigint", "a_month": kinds["month"], "a_fire": "bigint", "b_month": kinds["month"], "b_fire": "bigint", "rm": kinds["month"], "rf": "bigint"}

    def one(part: pd.DataFrame) -> pd.DataFrame:
        return tile_links(part, offsets).assign(**{c: part[c].iloc[0] for c in ("year", "tr", "tc")})[[*names]]

    links = materialise(sent.groupBy("year", "tr", "tc").applyInPandas(one, ", ".join(f"{c} {k}" for c, k in names.items())), "month-links")
    both = F.explode(F.array(*[F.struct(F.col(f"{k}_month").alias("m"), F.col(f"{k}_fire").alias("f")) for k in "ab"])).alias("g")
    stars = links.select("year", both, "rm", "rf").select("year", "g.m", "g.f", "rm", "rf")
    ends = _ends(stars)
    roots = _roots_joined(stars, ends)
    known = links.withColumn("node", F.struct("year", F.col("rm").alias("m"), F.col("rf").alias("f"))).join(roots, "node", "left").withColumn("label", F.coalesce("label", "node")).drop("node", "rm", "rf")
    sizes = materialise(known.groupBy("label").agg(F.count("*").alias("n")), "month-sets")
    known = materialise(known.join(sizes, "label"), "month-known")
    schema = f"year {kinds['year']}, g_month {kinds['month']}, g_fire bigint, last {kinds['month']}, fire_month {kinds['month']}, fire bigint"
    swept = known.where(F.col("n") <= most).groupBy("label").applyInPandas(lambda part: _sweep(part, months).assign(year=part.year.iloc[0])[["year", "g_month", "g_fire", "last", "fire_month", "fire"]], schema)
    large = known.where(F.col("n") > most).drop("label", "n")
    if not large.isEmpty():
        swept = swept.unionByName(_sweep_wide(large, months))
    swept = swept.select("year", F.col("g_month").alias("month"), F.col("g_fire").alias("fire"), "last", "fire_month", F.col("fire").alias("joined"))
    out = group.join(swept, ["year", "month", "fire"], "left")
    return out.select("year", "px", F.col("month").alias("month0"), F.coalesce("last", "month").alias("month"), F.coalesce("fire_month", "month").alias("fire_month"), F.coalesce("joined", "fire").alias("fire"))
