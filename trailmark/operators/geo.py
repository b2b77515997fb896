"""Map matching, containment and places over tracks. Ways and polygons are vertex tables; grid cells replace range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import METRES_PER_DEGREE, crosses_ray, haversine_miles, is_admin, local_metres, mercator_tile, num, segment_distance

#: Segments of a grid cell that are one row of it.
SEGMENTS = 1024


def way_segments(vertices: DataFrame, way: str = "way_id", idx: str = "idx") -> DataFrame:
    """(way, a_lat, a_lon, b_lat, b_lon) of adjacent vertices."""
    w = Window.partitionBy(way).orderBy(idx)
    rows = vertices.select(way, F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.lead("lat").over(w).alias("b_lat"), F.lead("lon").over(w).alias("b_lon"))
    return rows.where("b_lat is not null")


def match_ways(points: DataFrame, segments: DataFrame, radius_m: float = 25.0, near_m: float = 3.0, key: str = "ride_id", pid: str = "seq", way: str = "way_id") -> DataFrame:
    """(key, pid, way, dist_m) of points with a way within the radius: the first way, by id, with a segment closer than
    `near_m`, else the nearest way, the first on ties. Distances are on a plane at the ride's mean latitude.

    Segments and points meet in grid cells no smaller than the radius, by equi-join; a segment is in all cells of its padded box. A
    cell is a row for each `SEGMENTS` of its segments, so a point meets them as arrays and is a row, not a row for each segment.
    """
    cell = max(radius_m, 1.0) * 2 / METRES_PER_DEGREE
    lon_scale = 0.2  # cos of the highest latitude that is matched, 78 degrees; cells are as wide as needed there
    points = points.where("lat is not null and lon is not null").select(key, pid, "lat", "lon")
    middle = points.groupBy(key).agg(F.avg("lat").alias("lat0"))
    spots = points.join(middle, key).withColumn("cy", F.floor(F.col("lat") / cell)).withColumn("cx", F.floor(F.col("lon") / (cell / lon_scale)))
    pad = radius_m / METRES_PER_DEGREE
    span = lambda a, b, size, p: F.sequence(F.floor((F.least(a, b) - p) / size), F.floor((F.greatest(a, b) + p) / size))
    boxed = segments.withColumn("cy", F.explode(span("a_lat", "b_lat", cell, pad))).withColumn("cx", F.explode(span("a_lon", "b_lon", cell / lon_scale, pad / lon_scale)))
    boxed = boxed.withColumn("block", F.floor(F.row_number().over(Window.partitionBy("cy", "cx").orderBy(way, "a_lat", "a_lon", "b_lat", "b_lon")) / SEGMENTS))
    boxed = boxed.withColumn("s", F.least("a_lat", "b_lat") - pad * 1.001).withColumn("n", F.greatest("a_lat", "b_lat") + pad * 1.001)
    cells = boxed.groupBy("cy", "cx", "block").agg(F.collect_list(F.struct(way, "a_lat", "a_lon", "b_lat", "b_lon", "s", "n")).alias("segments")).drop("block")

    def distance(segment: Column) -> Column:
        ends = [local_metres(F.col("lat"), F.col("lon"), F.col("lat0"))] + [local_metres(segment[f"{c}_lat"], segment[f"{c}_lon"], F.col("lat0")) for c in "ab"]
        return segment_distance(*[x for xy in ends for x in xy])

    beside = F.filter("segments", lambda x: (F.col("lat") >= x["s"]) & (F.col("lat") <= x["n"]))  # spares distances
    near = F.filter(F.transform(beside, lambda x: F.struct(distance(x).alias("d"), x[way].alias(way))), lambda x: x["d"] < radius_m)
    found = spots.join(cells, ["cy", "cx"]).select(key, pid, near.alias("near")).where(F.size("near") > 0)
    close = F.array_min(F.transform(F.filter("near", lambda x: x["d"] < near_m), lambda x: F.struct(x[way].alias(way), x["d"].alias("d"))))
    best = found.select(key, pid, close.alias("close"), F.array_min("near").alias("nearest")).groupBy(key, pid).agg(F.min("close").alias("close"), F.min("nearest").alias("nearest"))
    return best.select(key, pid, F.coalesce(f"close.{way}", f"nearest.{way}").alias(way), F.coalesce("close.d", "nearest.d").alias("dist_m"))


def road_attribution(points: DataFrame, matches: DataFrame, ways: DataFrame, ref_points: int = 100, key: str = "ride_id", pid: str = "seq", way: str = "way_id") -> DataFrame:
    """(key, road, n_road, n_points, coverage): the name with most matched points; a route reference (each part of a
    `;` list counts) wins with `ref_points` points and at least as many as the name. Ties go to the first way."""
    total = points.where("lat is not null and lon is not null").groupBy(key).agg(F.count(F.lit(1)).alias("n_points"))
    named = matches.join(ways.select(way, "name", "ref"), way)
    refs = F.transform(F.split("ref", ";"), lambda x: F.struct(F.lit("ref").alias("kind"), F.trim(x).alias("value")))
    told = F.concat(F.array(F.struct(F.lit("name").alias("kind"), F.col("name").alias("value"))), F.coalesce(refs, F.array()))
    told = named.select(key, pid, F.explode(told).alias("told")).select(key, pid, "told.*").where("value is not null and (kind = 'name' or value <> '')")
    counted = told.groupBy(key, "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min(pid).alias("seen"))
    top = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("n", -F.col("seen"), "value"))).alias(kind)
    tops = counted.groupBy(key).agg(top("name"), top("ref")).select(key, F.col("name.n").alias("n_name"), F.col("name.value").alias("name"), F.col("ref.n").alias("n_ref"), F.col("ref.value").alias("ref"))
    rows = total.join(tops, key, "left")
    by_ref = (F.coalesce("n_ref", F.lit(0)) >= ref_points) & (F.coalesce("n_ref", F.lit(0)) >= F.coalesce("n_name", F.lit(0)))
    n = F.coalesce(F.when(by_ref, F.col("n_ref")).otherwise(F.col("n_name")), F.lit(0))
    return rows.select(key, F.coalesce(F.when(by_ref, F.col("ref")).otherwise(F.col("name")), F.lit("")).alias("road"), n.alias("n_road"), "n_points", (n / F.col("n_points")).alias("coverage"))


def shapes(vertices: DataFrame, poly: str = "poly_id") -> tuple[DataFrame, DataFrame]:
    """(vertices of the distinct outlines, each under the least id of the polygons that have it as `shape_id`; (poly, shape_id) of
    all polygons). Outlines are equal if their vertices are, in order."""
    point = F.struct(F.col("idx").alias("idx"), F.col("lat").alias("lat"), F.col("lon").alias("lon"))
    outlines = vertices.groupBy(poly).agg(F.array_sort(F.collect_list(point)).alias("outline"))
    outlines = outlines.select(poly, F.transform("outline", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("outline"))
    digest = F.sha2(F.to_json("outline"), 256)
    members = outlines.withColumn("shape_id", F.min(poly).over(Window.partitionBy(digest)))
    one = members.where(F.col(poly) == F.col("shape_id")).select("shape_id", F.posexplode("outline").alias("idx", "p"))
    return one.select("shape_id", "idx", "p.lat", "p.lon"), members.select(poly, "shape_id")


def points_in_shapes(points: DataFrame, vertices: DataFrame, key: str = "ride_id", pid: str = "seq", poly: str = "poly_id") -> DataFrame:
    """(key, pid, poly) of points inside polygons, by ray casting, for polygons whose outlines differ (`shapes`). Points and polygons'
    boxes meet in grid cells as large as the box (a power of two), so a box stands in four cells at most and small ones don't share
    a cell with all others; a point is asked for once for each size that there is. A polygon's
    height is cut into rows, about twice the root of its edges, and an edge stands in the rows that it crosses, so a point in the
    box meets only edges of its row, and a polygon with many points is as many keys as rows."""
    w = Window.partitionBy(poly).orderBy("idx")
    edges = vertices.select(poly, "lat", "lon", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"), F.first("lat").over(w).alias("lat0"), F.first("lon").over(w).alias("lon0"))
    edges = edges.select(poly, F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.coalesce("lat2", "lat0").alias("lat2"), F.coalesce("lon2", "lon0").alias("lon2"))
    boxes = vertices.groupBy(poly).agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.ceil(2 * F.sqrt(F.count(F.lit(1)).cast("double"))).cast("int").alias("n_rows"))
    side = F.greatest(F.col("n") - F.col("s"), F.col("e") - F.col("w"), num(1e-6))
    boxes = boxes.withColumn("size", F.pow(num(2), F.ceil(F.log2(side)).cast("double")))
    cell = lambda c: F.floor(F.col(c) / F.col("size"))
    boxed = boxes.withColumn("cy", F.explode(F.sequence(cell("s"), cell("n")))).withColumn("cx", F.explode(F.sequence(cell("w"), cell("e"))))
    # The row of a latitude rises with it, so an edge's rows hold those of all latitudes between its ends.
    row = lambda lat: F.when(F.col("n") > F.col("s"), F.floor((lat - F.col("s")) / (F.col("n") - F.col("s")) * F.col("n_rows"))).otherwise(F.lit(0))
    rising = edges.where("lat1 <> lat2").join(boxes.select(poly, "s", "n", "n_rows"), poly)  # a level edge crosses no ray
    rising = rising.withColumn("row", F.explode(F.sequence(row(F.least("lat1", "lat2")), row(F.greatest("lat1", "lat2"))))).drop("s", "n", "n_rows")
    spots = points.where("lat is not null and lon is not null").select(key, pid, "lat", "lon")
    sized = spots.crossJoin(F.broadcast(boxes.select("size").distinct()))  # powers of two: some tens at most
    sized = sized.withColumn("cy", cell("lat")).withColumn("cx", cell("lon"))
    inside_box = sized.join(boxed, ["size", "cy", "cx"]).where("lat between s and n and lon between w and e").select(key, pid, "lat", "lon", poly, row(F.col("lat")).alias("row"))
    crossed = inside_box.join(rising, [poly, "row"]).where(crosses_ray(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    return crossed.groupBy(key, pid, poly).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select(key, pid, poly)


def points_in_polygons(points: DataFrame, vertices: DataFrame, key: str = "ride_id", pid: str = "seq", poly: str = "poly_id") -> DataFrame:
    """(key, pid, poly) of points inside polygons: `points_in_shapes`, told of all polygons of a shape. Callers that only count or
    group polygons take the shapes with their `shapes` members instead, and spare a row for each polygon of the same outline."""
    outlines, members = shapes(vertices, poly)
    return points_in_shapes(points, outlines, key, pid, "shape_id").join(members, "shape_id").select(key, pid, poly)


def park_share(points: DataFrame, inside: DataFrame, names: DataFrame, members: DataFrame | None = None, key: str = "ride_id", poly: str = "poly_id") -> DataFrame:
    """(key, park, share): the park name, over all polygons of that name, that holds most of the ride's points; of names that
    hold as many, the one whose first polygon with a point, by id, comes first. `inside` has (key, poly) for each point in a polygon
    or, with `members` (poly, shape_id), (key, shape_id) for each point in a shape; points are counted before names are told."""
    total = points.where("lat is not null and lon is not null").groupBy(key).agg(F.count(F.lit(1)).alias("n_points"))
    shape = "shape_id" if members is not None else poly
    named = names.select(poly, "name", *([F.col(poly).alias("first")] if members is None else []))
    called = named.withColumn("n_polys", F.lit(1)) if members is None else members.join(named, poly).groupBy("shape_id", "name").agg(F.count(F.lit(1)).alias("n_polys"), F.min(poly).alias("first"))
    counted = inside.groupBy(key, shape).agg(F.count(F.lit(1)).alias("n"))
    held = counted.join(called, shape).groupBy(key, "name").agg(F.sum(F.col("n") * F.col("n_polys")).alias("n"), F.min("first").alias("first_poly"))
    top = held.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), "first_poly", "name")).alias("top"))
    return total.join(top, key, "left").select(key, F.coalesce("top.name", F.lit("")).alias("park"), (F.coalesce(-F.col("top.less"), F.lit(0)) / F.col("n_points")).alias("share"))


def best_place(pins: DataFrame, places: DataFrame, radius_m: float = 2500.0, key: str = "ride_id", cell: float = 0.05) -> DataFrame:
    """(key, place): within the radius, the place of lowest rank, then distance, then name; administrative names don't
    count. Pins (pin_lat, pin_lon) and places (lat, lon, rank, name) meet in grid cells."""
    lat_pad, lon_pad = radius_m / METRES_PER_DEGREE, radius_m / METRES_PER_DEGREE / 0.2
    span = lambda c, pad: F.sequence(F.floor((F.col(c) - pad) / cell), F.floor((F.col(c) + pad) / cell))
    asked = pins.withColumn("cy", F.explode(span("pin_lat", lat_pad))).withColumn("cx", F.explode(span("pin_lon", lon_pad)))
    # Of places at one spot only the first by rank and name can be told.
    spots = places.where(~is_admin(F.col("name"))).groupBy("lat", "lon").agg(F.min(F.struct("rank", "name")).alias("first")).select("lat", "lon", "first.rank", "first.name")
    there = spots.withColumn("cy", F.floor(F.col("lat") / cell)).withColumn("cx", F.floor(F.col("lon") / cell))
    d = haversine_miles(F.col("pin_lat"), F.col("pin_lon"), F.col("lat"), F.col("lon")) * 1609.344
    near = asked.join(there, ["cy", "cx"]).withColumn("d", d).where(F.col("d") <= radius_m)
    return near.groupBy(key).agg(F.min(F.struct("rank", "d", "name")).alias("best")).select(key, F.col("best.name").alias("place"))


def classified(points: DataFrame, loop_miles: float = 5.0, end_miles: float = 5.0, key: str = "ride_id", seq: str = "seq") -> DataFrame:
    """One row per entity: kind of route and its distances in miles. Farthest is the first point at the largest distance."""
    spots = points.where("lat is not null and lon is not null")
    ends = spots.groupBy(key).agg(F.min_by(F.struct("lat", "lon"), seq).alias("first"), F.max_by(F.struct("lat", "lon"), seq).alias("last"), F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    away = spots.join(ends.select(key, "first"), key).withColumn("d", haversine_miles(F.col("first.lat"), F.col("first.lon"), F.col("lat"), F.col("lon")))
    far = away.groupBy(key).agg(F.max("d").alias("max_dist_mi"), F.max_by(F.struct("lat", "lon"), F.struct("d", -F.col(seq))).alias("farthest"))
    length = points.groupBy(key).agg(F.coalesce(F.max("distance") / 1609.344, num(0)).alias("distance_mi"))
    rows = length.join(ends, key, "left").join(far, key, "left")
    end = F.coalesce(haversine_miles(F.col("first.lat"), F.col("first.lon"), F.col("last.lat"), F.col("last.lon")), num(0))
    box = F.coalesce(haversine_miles(F.col("s"), F.col("w"), F.col("n"), F.col("e")), num(0))
    kind = F.when(F.col("first").isNull(), "unknown").when(F.col("max_dist_mi") < loop_miles, "local_loop").when(end >= end_miles, "point_to_point").otherwise("out_and_back")
    none = F.col("first").isNull()
    return rows.select(key, kind.alias("ride_type"), F.coalesce("max_dist_mi", num(0)).alias("max_dist_mi"), end.alias("end_to_start_mi"), box.alias("bbox_diag_mi"), F.when(none, 0.0).otherwise(F.col("distance_mi")).alias("distance_mi"), F.col("first").alias("start_point"), "farthest", F.col("last").alias("end_point"))


def route_metadata(points: DataFrame, park: DataFrame, roads: DataFrame, places: DataFrame, key: str = "ride_id", seq: str = "seq", park_share_least: float = 0.5) -> DataFrame:
    """Classification with names: origin (the park of a local loop that it mostly stays in, else the place of the start),
    destination (the place of the terminus, or of the apex out and back), road and coverage."""
    from ..functions.scalars import without_prefix

    rows = classified(points, key=key, seq=seq)
    pin = F.when(F.col("ride_type") == "point_to_point", F.col("end_point")).when(F.col("ride_type") == "out_and_back", F.col("farthest"))
    rows = rows.withColumn("destination_point", pin)
    name = lambda c: F.upper(without_prefix(F.coalesce(c, F.lit("UNKNOWN"))))
    starts = best_place(rows.where("start_point is not null").select(key, F.col("start_point.lat").alias("pin_lat"), F.col("start_point.lon").alias("pin_lon")), places, key=key).withColumnRenamed("place", "start_place")
    ends = best_place(rows.where("destination_point is not null").select(key, F.col("destination_point.lat").alias("pin_lat"), F.col("destination_point.lon").alias("pin_lon")), places, key=key).withColumnRenamed("place", "end_place")
    rows = rows.join(starts, key, "left").join(ends, key, "left").join(park, key, "left").join(roads.select(key, "road", "coverage"), key, "left")
    in_park = (F.col("ride_type") == "local_loop") & (F.coalesce("share", num(0)) >= park_share_least)
    return rows.select(key, "ride_type", "distance_mi", F.when(in_park, F.upper("park")).otherwise(name(F.col("start_place"))).alias("origin"), F.when(F.col("destination_point").isNotNull(), name(F.col("end_place"))).otherwise("").alias("destination"), F.upper(F.coalesce("road", F.lit(""))).alias("road"), F.coalesce("coverage", num(0)).alias("coverage"))


def tile_cover(points: DataFrame, zoom: int, key: str = "ride_id") -> DataFrame:
    """(key, tile_x, tile_y): the tiles of all points and their eight neighbours."""
    x, y = mercator_tile(F.col("lat"), F.col("lon"), zoom)
    own = points.where("lat is not null and lon is not null").select(key, x.alias("x"), y.alias("y")).distinct()
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    return own.withColumn("o", around).select(key, (F.col("x") + F.col("o.dx")).alias("tile_x"), (F.col("y") + F.col("o.dy")).alias("tile_y")).distinct()
