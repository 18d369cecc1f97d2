"""View maps: what they keep in place, and images without size."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import geometry as G


def test_views(spark):
    rows = [(800, 600, 4000, 3000, 100.0, 50.0, 2.5), (300, 900, 1086, 1448, 10.0, 700.0, 0.5), (640, 480, 0, 10, 1.0, 1.0, 2.0), (640, 480, None, 10, 1.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "vw int, vh int, w int, h int, px double, py double, factor double")
    c = F.col
    views = df.withColumn("fit", G.fitted(c("vw"), c("vh"), c("w"), c("h"))).withColumn("zoom", G.zoomed(c("fit"), c("px"), c("py"), c("factor")))
    views = views.withColumn("mid", G.centred(c("zoom"), F.lit(30), F.lit(40), F.lit(20), F.lit(10), c("vw"), c("vh")))
    found = views.select("*", G.shown(c("fit"), c("w") / 2, c("h") / 2).alias("m"), G.shown(c("mid"), F.lit(40), F.lit(45)).alias("n")).collect()
    for r in found[:2]:
        assert (r["m"]["x"], r["m"]["y"]) == pytest.approx((r["vw"] / 2, r["vh"] / 2)) == (r["n"]["x"], r["n"]["y"])
        assert max(r["w"] * r["fit"]["scale"] / r["vw"], r["h"] * r["fit"]["scale"] / r["vh"]) == pytest.approx(1)
        before, after = (((r["px"] - v["tx"]) / v["scale"], (r["py"] - v["ty"]) / v["scale"]) for v in (r["fit"], r["zoom"]))
        assert before == pytest.approx(after)
        assert r["mid"]["scale"] == 6.0
    assert [(r["fit"], r["zoom"], r["mid"]) for r in found[2:]] == [(None, None, None)] * 2
