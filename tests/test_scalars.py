"""Known values of scalar expressions."""

import pytest
from pyspark.sql import functions as F

from trailmark.functions import scalars as s
from trailmark.operators import geo


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def test_thresholds(spark):
    for ftp, hr, want in ((200, 180, (290, 157)), (150, 160, (218, 139))):
        p, h = s.thresholds(F.lit(ftp), F.lit(hr))
        assert tuple(one(spark, p=p, h=h).values()) == want
    p, h = s.thresholds(F.lit(200), F.lit(180), F.lit(999), F.lit(600))
    assert tuple(one(spark, p=p, h=h).values()) == (999, 600)


RUBRIC = "struct<light:int,composition:int,motion:int,scenery:int,subject:int>"


def rubric(*values):
    names = ("light", "composition", "motion", "scenery", "subject")
    return F.struct(*[F.lit(v).cast("int").alias(n) for v, n in zip(values, names, strict=True)])


@pytest.mark.parametrize(
    ("visual", "action", "dims", "label", "want"),
    [
        (None, None, (10, 6, 4, 8, 2), (None, None), (7, 3)),
        (7, 4, None, (None, None), (7, 4)),
        (None, None, None, (None, None), (0, 0)),
        (None, None, None, (8, 2), (8, 2)),
        (9, 2, (1, 1, 1, 1, 1), (3, 3), (9, 2)),
        (None, 5, None, (3, 3), (0, 5)),
    ],
)
def test_rating_fold(spark, visual, action, dims, label, want):
    i = lambda v: F.lit(v).cast("int")
    r = rubric(*dims) if dims else F.lit(None).cast(RUBRIC)
    v, a = s.visual_action(i(visual), i(action), r, i(label[0]), i(label[1]))
    assert tuple(one(spark, v=v, a=a).values()) == want


def test_haversine(spark):
    d = one(spark, d=s.haversine_miles(F.lit(40.7484), F.lit(-73.9857), F.lit(40.7580), F.lit(-73.9855)))["d"]
    assert 0.6 < d < 0.9


def test_names(spark):
    rec, ch = s.chapter(F.lit("GX020123.MP4"))
    assert one(spark, a=rec, b=ch) == {"a": "0123", "b": 2}
    got = one(spark, a=s.sanitised_model(F.lit("org/model:v1")), b=s.sanitised_model(F.lit("plain-1.0")), c=s.clean_ref(F.lit("US 9W")), d=s.clean_ref(F.lit("I 87")), e=s.without_prefix(F.lit("Village of Piermont")))
    assert got["a"].startswith("org-model-v1_") and len(got["a"]) == len("org-model-v1_") + 8
    assert (got["b"], got["c"], got["d"], got["e"]) == ("plain-1.0", "9W", "I 87", "Piermont")


@pytest.mark.parametrize(
    ("text", "want", "ok"),
    [('{"a": 1}', '{"a":1}', True), ('```json\n[1, 2,]\n```', "[1,2]", True), ('so: {"b": 2} done', '{"b":2}', True), ("{broken", "{}", False), ("none", "[]", False)],
)
def test_json_repair(spark, text, want, ok):
    value, fine = s.parsed_json(F.lit(text))
    assert one(spark, v=value, o=fine) == {"v": want, "o": ok}


@pytest.mark.parametrize(
    ("span", "anchor", "trim", "floor", "want"),
    [((0, 10), 5, 3, 0, (3.5, 3.0)), ((4, 6), 5, 4, 0, (3.0, 4.0)), ((0, 10), 5, 3, 4, (3.5, 4.0)), ((0, 2), 0.5, 3, 0, (0.0, 2.0))],
)
def test_anchored_cut(spark, span, anchor, trim, floor, want):
    start, secs = s.anchored_cut(s.num(span[0]), s.num(span[1]), s.num(anchor), s.num(trim), float(floor))
    assert tuple(one(spark, a=start, b=secs).values()) == want


def track(spark, points):
    return spark.createDataFrame([(1, i, a, b, None) for i, (a, b) in enumerate(points)], "ride_id long, seq long, lat double, lon double, distance double")


def test_route_kinds(spark):
    import math

    circle = [(40 + math.cos(x / 8) / 69, -74 + math.sin(x / 8) / 69) for x in range(49)]
    out = [(40 + 0.01 * i, -74.0) for i in range(30)]
    kinds = [geo.classified(track(spark, p)).first()["ride_type"] for p in (circle, out + out[::-1], out, [(None, None)])]
    assert kinds == ["local_loop", "out_and_back", "point_to_point", "unknown"]


def test_point_in_polygon_and_segment(spark):
    d = one(spark, a=s.segment_distance(*map(s.num, (0, 5, -1, 0, 1, 0))), b=s.segment_distance(*map(s.num, (3, 4, 0, 0, 0, 0))))
    assert d == {"a": 5.0, "b": 5.0}


def test_bound_values_are_worked_out_once(spark):
    """Each mention of a step of a reply's parsing worked it out again."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        seen.add(1)
        return x

    once = spark.range(3).repartition(1).select(s.bound(counted(F.col("id").cast("int")), lambda v: F.struct((v + v).alias("a"), F.when(v > 0, v * v).alias("b"))).alias("r"))
    assert sorted((r["r"]["a"], r["r"]["b"]) for r in once.collect()) == [(0, None), (2, 1), (4, 4)] and seen.value == 3
