"""Raster, transform and hash queries."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.catalog.tables import table
from gridloom.operators import images as m
from gridloom.plans.durable import cut

SIDE, ANGLE, POINTS = 64, 30, 64


def _pixels(spark, side=SIDE):
    cells = spark.range(side * side).select((F.col("id") % side).alias("x"), F.expr(f"id div {side}").alias("y"))
    x, y = F.col("x"), F.col("y")
    return cells.select("x", "y", ((x * 5 + y * 3) % 256).alias("r"), ((x * 7 + y) % 256).alias("g"), ((x + y * 11) % 256).alias("b"))


def test_image(spark, sf_dir):
    return _pixels(spark)


def rgb_to_yuv(spark, sf_dir):
    return m.to_yuv(_pixels(spark))


def rotate_image(spark, sf_dir):
    return m.rotate(_pixels(spark), SIDE, SIDE, ANGLE)


def rotated_canvas(spark, sf_dir):
    sizes = [(a, *m.rotated_size(80, 60, a)) for a in (0, 30, 45, 90, 135)]
    return spark.createDataFrame(sizes, "degrees long, width long, height long")


def ycbcr_to_bgr(spark, sf_dir):
    named = _pixels(spark).select("x", "y", F.col("r").cast("int").alias("luma"), F.col("g").cast("int").alias("cb"), F.col("b").cast("int").alias("cr"))
    return m.from_ycbcr(named)


def _coefficients(spark):
    ks = spark.range(4 * 64).select(F.expr("id div 64").alias("block"), (F.col("id") % 64).alias("k"))
    return ks.select("block", "k", (((F.col("k") * 7 + F.col("block") * 13) % 11 - 5) * F.when(F.col("k") < 10, 1.0).otherwise(0.0)).alias("c"))


def inverse_dct(spark, sf_dir):
    quantisers = spark.range(64).select(F.col("id").alias("k"), (3.0 + F.col("id") % 5).alias("q"))
    return m.inverse_dct(_coefficients(spark), quantisers)


def _signal(spark, sf_dir):
    """All events, added up by their number modulo POINTS."""
    slot = (F.col("event_id") % POINTS).alias("i")
    summed = table(spark, sf_dir, "events").groupBy(slot).agg(F.sum("value").alias("re"))
    slots = spark.range(POINTS).select(F.col("id").alias("i"))
    return slots.join(F.broadcast(summed), "i", "left").select("i", F.coalesce("re", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))


def _lines(spark, sf_dir):
    """All events in lines of POINTS consecutive ones; the last is filled up with zeros."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    parts = events.repartitionByRange("event_id").sortWithinPartitions("event_id").withColumn("part", F.spark_partition_id())
    parts = cut(parts.withColumn("k", F.monotonically_increasing_id() % (1 << 33)))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # a row of each partition
    at = F.col("k") + F.col("start")
    placed = parts.join(F.broadcast(starts), "part").select(F.expr(f"(k + start) div {POINTS}").alias("line"), (at % POINTS).alias("i"), F.col("value").alias("re"))
    slots = placed.select("line").distinct().crossJoin(spark.range(POINTS).select(F.col("id").alias("i")))
    return cut(slots.join(placed, ["line", "i"], "left").select("line", "i", F.coalesce("re", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im")))


def dft(spark, sf_dir):
    out = m.dft(_signal(spark, sf_dir), POINTS)
    return out.select("k", F.round("re", 3) + 0.0, F.round("im", 3) + 0.0).toDF("k", "re", "im")


def fft_roundtrip(spark, sf_dir):
    """Forward and back gives the signal times its length, on every line of events."""
    signal = _lines(spark, sf_dir)
    back = m.fft_lines(m.fft_lines(signal, "line", "i"), "line", "i", inverse=True)
    scaled = back.select("line", "i", (F.col("re") / POINTS).alias("re"), (F.col("im") / POINTS).alias("im"))
    return m.differences(scaled, signal, ["line", "i"]).select((F.col("largest") < 1e-9).alias("ok"))


def fft_matches_dft(spark, sf_dir):
    """Both transforms of every line of events."""
    signal = _lines(spark, sf_dir)
    fast = m.fft_lines(signal, "line", "i").withColumnRenamed("i", "k")
    return m.differences(fast, m.dft(signal, POINTS, by=("line",)), ["line", "k"]).select((F.col("largest") < 1e-6).alias("ok"), (F.col("mean") <= F.col("largest")).alias("ordered"))


def fft_plane(spark, sf_dir):
    """Two axes of an 8 x 8 picture of the signal."""
    picture = _signal(spark, sf_dir).select(F.expr("i div 8").alias("r"), (F.col("i") % 8).alias("c"), "re", "im")
    both = m.fft_axes(picture, ("r", "c"))
    return both.select("c", "r", F.round("re", 3) + 0.0, F.round("im", 3) + 0.0).toDF("c", "r", "re", "im")


def fft_cube(spark, sf_dir):
    """Three axes of a 4 x 4 x 4 cube of the signal."""
    cube = _signal(spark, sf_dir).select(F.expr("i div 16").alias("z"), F.expr("i div 4 % 4").alias("y"), (F.col("i") % 4).alias("x"), "re", "im")
    out = m.fft_axes(cube, ("z", "y", "x"))
    return out.select("z", "y", "x", F.round("re", 3) + 0.0, F.round("im", 3) + 0.0).toDF("z", "y", "x", "re", "im")


def md5_documents(spark, sf_dir):
    return m.digests(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        test_image, rgb_to_yuv, rotate_image, rotated_canvas, ycbcr_to_bgr, inverse_dct, dft, fft_roundtrip, fft_matches_dft, fft_plane, fft_cube, md5_documents,
    )
}

_PIX = f"px AS (SELECT x, y, (x * 5 + y * 3) % 256 AS r, (x * 7 + y) % 256 AS g, (x + y * 11) % 256 AS b FROM range({SIDE}) a(x), range({SIDE}) c(y))"
_SIG = f"sg AS (SELECT i, coalesce(sum(value), 0) AS re FROM range({POINTS}) t(i) LEFT JOIN events ON event_id % {POINTS} = i GROUP BY i)"
_W, _H = m.rotated_size(SIDE, SIDE, ANGLE)
_C, _S = math.cos(math.radians(ANGLE)), math.sin(math.radians(ANGLE))

ORACLE_SQL = {
    "test_image": f"WITH {_PIX} SELECT * FROM px",
    "rgb_to_yuv": f"""WITH {_PIX} SELECT x, y, CAST(round(0.256788::DOUBLE * r + 0.504129::DOUBLE * g + 0.097906::DOUBLE * b) + 16 AS INTEGER) AS luma,
CAST(round(-0.148223::DOUBLE * r - 0.290993::DOUBLE * g + 0.439216::DOUBLE * b) + 128 AS INTEGER) AS u,
CAST(round(0.439216::DOUBLE * r - 0.367788::DOUBLE * g - 0.071427::DOUBLE * b) + 128 AS INTEGER) AS v FROM px""",
    "rotate_image": f"""WITH {_PIX}, t AS (SELECT x, y, round((x - {(_W - 1) / 2}::DOUBLE) * {_C!r}::DOUBLE + (y - {(_H - 1) / 2}::DOUBLE) * {_S!r}::DOUBLE + {(SIDE - 1) / 2}, 9) AS sx,
  round((y - {(_H - 1) / 2}::DOUBLE) * {_C!r}::DOUBLE - (x - {(_W - 1) / 2}::DOUBLE) * {_S!r}::DOUBLE + {(SIDE - 1) / 2}, 9) AS sy FROM range({_W}) a(x), range({_H}) c(y)),
k AS (SELECT x, y, floor(sx) + i AS px, floor(sy) + j AS py, abs(1 - i - (sx - floor(sx))) * abs(1 - j - (sy - floor(sy))) AS w FROM t, range(2) a(i), range(2) c(j))
SELECT k.x, k.y, CAST(floor(round(sum(w * coalesce(r, 0)), 6)) AS INTEGER) AS r, CAST(floor(round(sum(w * coalesce(g, 0)), 6)) AS INTEGER) AS g,
CAST(floor(round(sum(w * coalesce(b, 0)), 6)) AS INTEGER) AS b FROM k LEFT JOIN px ON px.x = k.px AND px.y = k.py GROUP BY k.x, k.y""",
    "rotated_canvas": """SELECT CAST(d AS BIGINT) AS degrees, CAST(ceil(80 * abs(cos(radians(d))) + 60 * abs(sin(radians(d))) - 1e-9) AS BIGINT) AS width,
CAST(ceil(80 * abs(sin(radians(d))) + 60 * abs(cos(radians(d))) - 1e-9) AS BIGINT) AS height FROM (VALUES (0), (30), (45), (90), (135)) t(d)""",
    "ycbcr_to_bgr": f"""WITH {_PIX}, f AS (SELECT x, y, r * 1024 + 512 AS l, CAST(g AS BIGINT) - 128 AS cb, CAST(b AS BIGINT) - 128 AS cr FROM px)
SELECT x, y, CAST(least(255, greatest(0, floor((l + 1815 * cb) / 1024.0))) AS INTEGER) AS b,
CAST(least(255, greatest(0, floor((l - 352 * cb - 731 * cr) / 1024.0))) AS INTEGER) AS g,
CAST(least(255, greatest(0, floor((l + 1436 * cr) / 1024.0))) AS INTEGER) AS r FROM f""",
    "inverse_dct": """WITH c AS (SELECT block, k, ((k * 7 + block * 13) % 11 - 5) * CASE WHEN k < 10 THEN 1.0::DOUBLE ELSE 0 END * (3.0 + k % 5) AS f FROM range(4) a(block), range(64) b(k)),
s AS (SELECT block, place, sum(f * CASE WHEN k // 8 = 0 THEN sqrt(1 / 8.0) ELSE 0.5 END * CASE WHEN k % 8 = 0 THEN sqrt(1 / 8.0) ELSE 0.5 END
  * cos((2 * (place % 8) + 1) * (k % 8) * pi() / 16) * cos((2 * (place // 8) + 1) * (k // 8) * pi() / 16)) AS s FROM c, range(64) t(place) GROUP BY block, place)
SELECT block, place, CAST(least(255, greatest(0, round(round(s, 6) + 128))) AS INTEGER) AS value FROM s""",
    "dft": f"""WITH {_SIG} SELECT k, round(sum(re * cos(2 * pi() * ((i * k) % {POINTS}) / {POINTS})), 3) + 0.0 AS re,
round(-sum(re * sin(2 * pi() * ((i * k) % {POINTS}) / {POINTS})), 3) + 0.0 AS im FROM sg, range({POINTS}) t(k) GROUP BY k""",
    "fft_roundtrip": "SELECT true AS ok",
    "fft_matches_dft": "SELECT true AS ok, true AS ordered",
    "fft_plane": f"""WITH {_SIG}, t AS (SELECT c, r, re, 2 * pi() * ((i // 8 * r + i % 8 * c) % 8) / 8 AS a FROM sg, range(8) x(r), range(8) y(c))
SELECT c, r, round(sum(re * cos(a)), 3) + 0.0 AS re, round(-sum(re * sin(a)), 3) + 0.0 AS im FROM t GROUP BY c, r""",
    "fft_cube": f"""WITH {_SIG}, t AS (SELECT z, y, x, re, 2 * pi() * ((i // 16 * z + i // 4 % 4 * y + i % 4 * x) % 4) / 4 AS a FROM sg, range(4) p(z), range(4) q(y), range(4) r(x))
SELECT z, y, x, round(sum(re * cos(a)), 3) + 0.0 AS re, round(-sum(re * sin(a)), 3) + 0.0 AS im FROM t GROUP BY z, y, x""",
    "md5_documents": "SELECT doc_id, md5(text) AS md5 FROM documents",
}
