"""Unit facts and properties of the column functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from frameloom.functions import casts as C
from frameloom.functions import geometry as G
from frameloom.functions import jsontext as J
from frameloom.functions import labels as L
from frameloom.functions import scores as S
from frameloom.functions import vectors as X


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("label", "display"), [("pot", "cookware:pot"), ("pan", "cookware:pan"), ("lid", "cookware:lid"), ("carton", "container:carton"), ("olive", "ingredient:olive"), ("sponge", "kitchen_scene:sponge"), ("unknown_object", "unknown:unknown_object")])
def test_display_labels(spark, label, display):
    assert one(spark, L.display(F.lit(label)), L.review_coarse(F.lit(label))) == (display, display.split(":")[0])


def test_normalisation(spark):
    got = one(spark, L.normalize(F.lit("  Cutting   Board ")), L.normalize(F.lit("")), L.normalize(F.lit(None).cast("string")), L.fine(F.lit("Tea Kettle")), L.fine(F.lit(" Odd ")), L.clean_display(F.lit("##s")), L.clean_display(F.lit(None).cast("string"), ""))
    assert got == ("cutting board", "unknown", "unknown", "kettle", "Odd", "unknown", "")


def test_parsed_labels(spark):
    p = lambda x: tuple(one(spark, L.parse_display(F.lit(x)))[0])
    assert p("cookware:pot") == ("cookware", "pot")
    assert p("unknown:pot") == ("cookware", "pot")
    assert p("pot") == ("cookware", "pot")
    assert p("a:b:c") == ("a", "b:c")
    assert p("") == ("unknown", "unknown")


def test_casts(spark):
    texts = ["3.7", "-3.7", " 4 ", "x", "", "nan", "1e3"]
    assert [one(spark, C.to_int(F.lit(t)))[0] for t in texts] == [3, -3, 4, -1, -1, -1, 1000]
    assert one(spark, C.to_int(F.lit(None).cast("string"), 9), C.to_float(F.lit("2.5")), C.to_float(F.lit("?"))) == (9, 2.5, 0.0)
    assert [one(spark, C.to_bool(F.lit(t), True))[0] for t in ["YES", "n", "0", "", "maybe"]] == [True, False, False, True, True]
    assert one(spark, C.first_present(F.lit(" "), F.lit(None).cast("string"), F.lit("b"), F.lit("c"))) == ("b",)


A, B, INSIDE, FAR, EMPTY = (0, 0, 10, 10), (5, 5, 15, 15), (2, 2, 4, 4), (20, 20, 30, 30), (5, 5, 5, 5)


def box(t):
    return G.box(*[F.lit(float(v)) for v in t])


def test_box_pairs(spark):
    f = lambda a, b: one(spark, G.iou(box(a), box(b)), G.overlap_ratio(box(a), box(b)), G.containment(box(a), box(b)))
    assert f(A, B) == pytest.approx((25 / 175, 0.25, 0.25))
    assert f(A, INSIDE) == pytest.approx((0.04, 1.0, 1.0))
    assert f(A, FAR) == f(A, EMPTY) == (0.0, 0.0, 0.0)
    assert f(A, A) == (1.0, 1.0, 1.0)


def test_box_properties(spark):
    r = spark.range(400).select(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(60)) - 5).cast("double").alias(f"v{i}") for i in range(8)])
    a = G.box("v0", "v1", F.col("v0") + F.abs("v2"), F.col("v1") + F.abs("v3"))
    b = G.box("v4", "v5", F.col("v4") + F.abs("v6"), F.col("v5") + F.abs("v7"))
    bad = r.where((G.iou(a, b) != G.iou(b, a)) | (G.iou(a, b) < 0) | (G.iou(a, b) > 1) | (G.containment(a, b) < G.iou(a, b) - 1e-12) | (G.overlap_ratio(a, b) > 1 + 1e-12))
    assert bad.count() == 0


def test_box_moves(spark):
    assert tuple(one(spark, G.shifted(box((5, 5, 8, 8)), F.lit(-20.0), F.lit(500.0), 100, 50))[0]) == (0.0, 49.0, 1.0, 50.0)
    assert one(spark, G.near_edge(box((0, 0, 100, 50)), 100, 50), G.near_edge(box((45, 24.5, 50, 25)), 100, 50)) == ("left+right+top+bottom", None)
    assert tuple(one(spark, G.scaled(box(A), F.lit(1.0001), 100, 100))[0]) == tuple(map(float, A))
    assert one(spark, G.from_array(F.array(F.lit(1.0))))[0] is None


def test_scores(spark):
    assert [one(spark, S.recovery_budget(F.lit(q)))[0] for q in (0.95, 0.85, 0.75, 0.65, 0.55, 0.5)] == [5, 4, 3, 2, 1, 0]
    e, empty = one(spark, S.entropy(F.array(F.lit(1.0), F.lit(1.0))), S.entropy(F.array().cast("array<double>")))
    assert e == pytest.approx(0.693147, abs=1e-5) and empty == 0
    assert one(spark, S.stability(F.array(F.lit(1.0))), S.stability(F.array(F.lit(1.0), F.lit(1.0)))) == (0.5, 1.0)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0), F.lit(9.0))
    assert one(spark, X.norm(a), X.dot(a, b), X.unit(a)) == (5.0, 24.0, [0.6, 0.8])
    assert one(spark, X.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == (0.0,)


def test_json_in_text(spark):
    schema = "decision string, confidence double"
    got = [one(spark, J.response(F.lit(t), schema))[0] for t in ('```json\n{"decision": "keep", "confidence": 1}\n```', 'x {"decision": "delete", "confidence": 0.5', '{"decision": "unfin', "nothing")]
    assert [g and tuple(g) for g in got] == [("keep", 1.0), ("delete", 0.5), ("unfin", None), None]


def test_prompts(spark):
    assert one(spark, L.prompt_labels(F.lit("Lid, pot lid ,CUP,,cup")))[0] == ["lid", "pot lid", "pan lid", "CUP"]
    assert one(spark, L.prompt_matches(F.lit("pot-lid"), F.lit("big pot lid")), L.prompt_matches(F.lit("pot"), F.lit("potato"))) == (True, False)
