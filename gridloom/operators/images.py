"""Rasters as rows ``x, y`` with colour columns; transforms of signals and blocks; hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.bounded import broadcast_if_small
from gridloom.plans.shipping import ship

#: Coefficients of studio-range luma and chroma.
YUV = {"y": (0.256788, 0.504129, 0.097906, 16), "u": (-0.148223, -0.290993, 0.439216, 128), "v": (0.439216, -0.367788, -0.071427, 128)}
#: Chroma to colour factors, used with so many bits after the point.
RED_CR, GREEN_CB, GREEN_CR, BLUE_CB, SCALE_BITS = 1.40200, 0.34414, 0.71414, 1.77200, 10


def to_yuv(pixels: DataFrame) -> DataFrame:
    """``x, y`` with luma ``luma`` and chroma ``u, v``, rounded."""
    made = {}
    for name, (r, g, b, shift) in YUV.items():
        made[name] = (F.round(r * F.col("r") + g * F.col("g") + b * F.col("b")) + shift).cast("int")
    return pixels.select("x", "y", made["y"].alias("luma"), made["u"].alias("u"), made["v"].alias("v"))


def rotated_size(width: int, height: int, degrees: int) -> tuple[int, int]:
    """Width and height of the canvas that holds the rotated raster."""
    a = math.radians(degrees)
    c, s = abs(math.cos(a)), abs(math.sin(a))
    return math.ceil(width * c + height * s - 1e-9), math.ceil(width * s + height * c - 1e-9)


def rotate(pixels: DataFrame, width: int, height: int, degrees: int) -> DataFrame:
    """``x, y, r, g, b`` of the rotated raster: each target looks up its source and the three pixels beyond, black outside."""
    a = math.radians(degrees)
    cos, sin = math.cos(a), math.sin(a)
    new_w, new_h = rotated_size(width, height, degrees)
    spark = pixels.sparkSession
    target = spark.range(new_w * new_h).select((F.col("id") % new_w).alias("x"), F.expr(f"id div {new_w}").alias("y"))
    tx, ty = F.col("x") - (new_w - 1) / 2, F.col("y") - (new_h - 1) / 2
    source = target.select(
        "x", "y", F.round(tx * cos + ty * sin + (width - 1) / 2, 9).alias("sx"), F.round(ty * cos - tx * sin + (height - 1) / 2, 9).alias("sy")
    )
    at = source.select("x", "y", F.floor("sx").alias("px"), F.floor("sy").alias("py"), (F.col("sx") - F.floor("sx")).alias("wx"), (F.col("sy") - F.floor("sy")).alias("wy"))
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))).alias("k")
    weight = F.when(F.col("k.i") == 1, F.col("wx")).otherwise(1 - F.col("wx")) * F.when(F.col("k.j") == 1, F.col("wy")).otherwise(1 - F.col("wy"))
    samples = at.select("*", corner).select("x", "y", (F.col("px") + F.col("k.i")).alias("px"), (F.col("py") + F.col("k.j")).alias("py"), weight.alias("w"))
    colours = pixels.select(F.col("x").alias("px"), F.col("y").alias("py"), "r", "g", "b")
    mixed = samples.join(colours, ["px", "py"], "left").groupBy("x", "y")
    return mixed.agg(*(F.floor(F.round(F.sum(F.col("w") * F.coalesce(c, F.lit(0))), 6)).cast("int").alias(c) for c in "rgb"))


def _fixed(factor: float) -> int:
    return int(factor * (1 << SCALE_BITS) + 0.5)


def from_ycbcr(pixels: DataFrame) -> DataFrame:
    """``x, y, b, g, r`` of luma and chroma bytes ``luma, cb, cr`` in fixed point, half up, clamped."""
    luma = F.shiftleft("luma", SCALE_BITS) + (1 << (SCALE_BITS - 1))
    cb, cr = F.col("cb") - 128, F.col("cr") - 128

    def clamp(value: Column) -> Column:
        return F.least(F.lit(255), F.greatest(F.lit(0), F.shiftright(value.cast("int"), SCALE_BITS)))

    red = luma + _fixed(RED_CR) * cr
    green = luma - _fixed(GREEN_CB) * cb - _fixed(GREEN_CR) * cr
    blue = luma + _fixed(BLUE_CB) * cb
    return pixels.select("x", "y", clamp(blue).alias("b"), clamp(green).alias("g"), clamp(red).alias("r"))


def cosine_basis(spark) -> DataFrame:
    """``k, place, w``: what coefficient k of an 8 x 8 block adds to its sample ``place``."""
    rows = []
    for v in range(8):
        for u in range(8):
            scale = (0.5 if v else math.sqrt(1 / 8)) * (0.5 if u else math.sqrt(1 / 8))
            for y in range(8):
                for x in range(8):
                    w = scale * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16)
                    rows.append((8 * v + u, 8 * y + x, w))
    return spark.createDataFrame(rows, "k long, place long, w double")


def inverse_dct(coefficients: DataFrame, quantisers: DataFrame) -> DataFrame:
    """``block, place, value``: samples 0..255 of ``block, k, c`` with ``k, q``."""
    scaled = coefficients.join(broadcast_if_small(quantisers), "k").select("block", "k", (F.col("c") * F.col("q")).alias("f"))
    spread = scaled.join(F.broadcast(cosine_basis(coefficients.sparkSession)), "k")
    sums = spread.groupBy("block", "place").agg(F.sum(F.col("f") * F.col("w")).alias("s"))
    return sums.select("block", "place", F.least(F.lit(255), F.greatest(F.lit(0), F.round(F.round(F.col("s"), 6) + 128).cast("int"))).alias("value"))


def dft(signal: DataFrame, n: int, inverse: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """``k, re, im`` of ``i, re, im``, by definition, without scaling; for short signals, one for each value of ``by``."""
    sign = 2 * math.pi / n * (1 if inverse else -1)
    outputs = signal.sparkSession.range(n).select(F.col("id").alias("k"))
    terms = signal.crossJoin(broadcast_if_small(outputs)).withColumn("t", ((F.col("i") * F.col("k")) % n) * sign)
    re = F.col("re") * F.cos("t") - F.col("im") * F.sin("t")
    im = F.col("re") * F.sin("t") + F.col("im") * F.cos("t")
    return terms.groupBy(*by, "k").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def _transformed(re: np.ndarray, im: np.ndarray, sizes: np.ndarray, inverse: bool) -> np.ndarray:
    """Transforms of lines that lie one after the other; lines of one size are one call."""
    values, out = re + 1j * im, np.empty(len(re), np.complex128)
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes > 0]):
        at = starts[sizes == n][:, None] + np.arange(n)
        out[at] = np.fft.ifft(values[at]) * n if inverse else np.fft.fft(values[at])
    return out


def fft_lines(signal: DataFrame, line: str, place: str, inverse: bool = False) -> DataFrame:
    """Transform of each line of ``line, place, re, im``; one line in one task, many lines in one call.

    Two- and three-dimensional transforms are one call for each axis.
    """
    ship(signal.sparkSession)
    point = F.struct(F.col(place).cast("long").alias("place"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    lines = signal.groupBy(F.col(line).alias("line")).agg(F.array_sort(F.collect_list(point)).alias("points"))
    kind = lines.schema["line"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["points"].value_lengths().to_numpy(zero_copy_only=False)
            place_, re, im = batch["points"].flatten().flatten()
            out = _transformed(re.to_numpy(zero_copy_only=False), im.to_numpy(zero_copy_only=False), sizes, inverse)
            named = batch["line"].take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([named, place_, pa.array(out.real), pa.array(out.imag)], ["line", "place", "re", "im"])

    made = lines.mapInArrow(run, f"line {kind}, place long, re double, im double")
    return made.withColumnsRenamed({"line": line, "place": place})


def fft_axes(signal: DataFrame, axes: tuple[str, ...], inverse: bool = False) -> DataFrame:
    """Transform of ``*axes, re, im`` along all axes, one after the other."""
    for place in axes:
        others = [a for a in axes if a != place]
        keyed = signal.withColumn("line", F.concat_ws(",", *others))
        moved = fft_lines(keyed, "line", place, inverse)
        parts = F.split("line", ",")
        signal = moved.select(*(parts[others.index(a)].cast("long").alias(a) if a in others else F.col(a) for a in axes), "re", "im")
    return signal


def differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``largest, mean`` absolute difference of two complex signals."""
    both = a.join(b.select(*keys, F.col("re").alias("re2"), F.col("im").alias("im2")), keys)
    d = F.sqrt(F.pow(F.col("re") - F.col("re2"), 2) + F.pow(F.col("im") - F.col("im2"), 2))
    return both.agg(F.max(d).alias("largest"), F.avg(d).alias("mean"))


def digests(buffers: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """MD5 of each buffer; nothing is shuffled."""
    return buffers.select(id_col, F.md5(F.col(data_col).cast("binary")).alias("md5"))
