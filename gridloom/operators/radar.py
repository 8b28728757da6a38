"""A space-time adaptive radar chain on complex rows ``..., re, im``."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.plans.bounded import broadcast_if_small
from gridloom.plans.shipping import ship

#: Real chirp coefficients; the imaginary parts are zero.
CHIRP = (
    1.0, 0.93461, 0.832174452, 0.617829847, 0.309016994, -0.382683432, -0.891615484, -0.66535522,
    0.251076308, 0.747688, -1.75436e-11, -0.623073334, 0.173822059, 0.380202983, -0.416087226, 0.143506287,
)
#: Fixed values of the detector: window gates and velocities, power over the neighbours and over the padding value.
GATES, VELOCITIES, OVER_NEIGHBOURS, OVER_POWER = 7, 5, 10.0, 10_000.0
#: Least power of a detection, and how many are kept.
LEAST_POWER, MOST_DETECTIONS = 1e-5, 100


@dataclass(frozen=True)
class Radar:
    """Angles and velocities looked at, pulses and antennas of a filter, and the platform."""

    angles: int
    velocities: int
    pulses: int
    antennas: int
    wavelength: float = 0.03
    period: float = 0.0005
    beam_width: float = 2.28
    beam_angle: float = 45.0
    spacing: float = 0.3
    speed: float = 100.0
    distance: float = 10_000.0

    @property
    def fastest(self) -> float:
        return self.wavelength / (4 * self.period)


def velocity_of(v: Column, n: int, fastest: float) -> Column:
    """Velocity in the middle of a bin; the upper half of the bins is negative."""
    middle = (2.0 * v + 1) * (fastest / n)
    return F.when(v >= n // 2, middle - 2 * fastest).otherwise(middle)


def velocity_bin(velocity: Column, n: int, fastest: float) -> Column:
    shifted = F.when(velocity >= 0, velocity).otherwise(velocity + 2 * fastest)
    bin_ = F.floor(1e-5 + shifted / (2 * fastest / n))
    return F.least(F.greatest(bin_, F.lit(0)), F.lit(n - 1)).cast("long")


def angle_of(th: Column, n: int, width: float) -> Column:
    return math.radians(width) * (-0.5 + (2.0 * th + 1) / (2.0 * n))


def angle_bin(angle: Column, n: int, width: float) -> Column:
    beam = math.radians(width)
    bin_ = F.floor(0.5 + (angle + beam / 2) / (beam / n))
    return F.least(F.greatest(bin_, F.lit(0)), F.lit(n - 1)).cast("long")


def _grid(spark: SparkSession, **sizes: int) -> DataFrame:
    out, step = spark.range(math.prod(sizes.values())), 1
    for name, size in reversed(sizes.items()):
        out = out.withColumn(name, F.expr(f"id div {step} % {size}"))
        step *= size
    return out.select(*sizes)


def chirp(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(j, c, 0.0) for j, c in enumerate(CHIRP)], "tap long, re double, im double")


def steering(spark: SparkSession, radar: Radar) -> DataFrame:
    """``th, v, k, re, im``: phases that a target of an angle and velocity has at antenna and pulse k = ant + antennas * pulse."""
    cells = _grid(spark, th=radar.angles, v=radar.velocities, pulse=radar.pulses, ant=radar.antennas)
    beam, wave = math.radians(radar.beam_angle), 2 * math.pi / radar.wavelength
    shift = (radar.spacing * F.col("ant") - radar.speed * radar.period * F.col("pulse")) * (math.sin(beam) / radar.distance)
    direction = beam + angle_of(F.col("th"), radar.angles, radar.beam_width) + shift
    velocity = velocity_of(F.col("v"), radar.velocities, radar.fastest)
    phase = wave * radar.spacing * F.col("ant") * F.cos(direction) - 2 * wave * velocity * radar.period * F.col("pulse")
    return cells.select("th", "v", (F.col("ant") + radar.antennas * F.col("pulse")).alias("k"), F.cos(phase).alias("re"), F.sin(phase).alias("im"))


def doppler_table(spark: SparkSession, radar: Radar, length: int) -> DataFrame:
    """``v, k, re, im``: phases of each velocity from pulse to pulse."""
    velocity = velocity_of(F.col("v"), radar.velocities, radar.fastest)
    turn = (4 * math.pi * radar.period / radar.wavelength) * F.col("k") * velocity
    return _grid(spark, v=radar.velocities, k=length).select("v", "k", F.cos(turn).alias("re"), (-F.sin(turn)).alias("im"))


def _times(a: str, b: str) -> tuple[Column, Column]:
    """Real and imaginary part of a product of two complex columns."""
    ar, ai, br, bi = (F.col(f"{x}.{p}") for x in (a, b) for p in ("re", "im"))
    return ar * br - ai * bi, ar * bi + ai * br


def _times_conjugate(a: str, b: str) -> tuple[Column, Column]:
    ar, ai, br, bi = (F.col(f"{x}.{p}") for x in (a, b) for p in ("re", "im"))
    return ar * br + ai * bi, ai * br - ar * bi


def _summed(parts: tuple[Column, Column]) -> list[Column]:
    return [F.sum(parts[0]).alias("re"), F.sum(parts[1]).alias("im")]


def pulse_compression(signal: DataFrame, taps: DataFrame, gates: int) -> DataFrame:
    """``ant, pulse, gate, re, im``: sliding sums of the taps' products; as many gates fewer as there are taps, but one."""
    n = taps.count()
    met = signal.alias("s").crossJoin(broadcast_if_small(taps).alias("t"))
    out = met.select("s.ant", "s.pulse", (F.col("s.gate") - F.col("t.tap")).alias("gate"), *(p.alias(c) for p, c in zip(_times("s", "t"), ("re", "im"), strict=True)))
    return out.where(F.col("gate").between(0, gates - n)).groupBy("ant", "pulse", "gate").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def covariance(signal: DataFrame, radar: Radar, received: int) -> DataFrame:
    """``gate, i, j, re, im``: averaged space-time covariance of each gate over sliding windows of pulses."""
    lags = F.broadcast(signal.sparkSession.range(radar.pulses).select(F.col("id").alias("r")))
    windows = signal.crossJoin(lags).select("gate", (F.col("pulse") - F.col("r")).alias("l"), (F.col("ant") + radar.antennas * F.col("r")).alias("k"), "re", "im")
    windows = windows.where(F.col("l").between(0, received - radar.pulses))
    met = windows.alias("a").join(windows.alias("b"), ["gate", "l"])
    return met.groupBy("gate", F.col("a.k").alias("i"), F.col("b.k").alias("j")).agg(*_summed(_times_conjugate("a", "b")))


def inverses(matrices: DataFrame) -> DataFrame:
    """Inverse of the complex matrix of each gate, one gate in a task."""
    ship(matrices.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows.i.max()) + 1
        a = np.zeros((n, n), dtype=complex)
        a[rows.i, rows.j] = rows.re.to_numpy() + 1j * rows.im.to_numpy()
        inverse = np.linalg.inv(a)
        i, j = np.indices((n, n)).reshape(2, -1)
        return pd.DataFrame({"gate": rows.gate.iloc[0], "i": i, "j": j, "re": inverse.real.ravel(), "im": inverse.imag.ravel()})

    return matrices.groupBy("gate").applyInPandas(run, "gate long, i long, j long, re double, im double")


def filter_weights(inverse: DataFrame, vectors: DataFrame) -> DataFrame:
    """``gate, th, v, k, re, im``: the inverse applied to each steering vector, scaled to gain one."""
    vectors = broadcast_if_small(vectors)
    met = inverse.alias("c").join(vectors.alias("s"), F.col("c.i") == F.col("s.k"))
    w = met.groupBy(F.col("c.gate"), F.col("s.th"), F.col("s.v"), F.col("c.j").alias("k")).agg(*_summed(_times_conjugate("c", "s")))
    gained = w.alias("w").join(vectors.alias("s"), ["th", "v", "k"])
    gain = gained.groupBy("gate", "th", "v").agg(F.sum(_times("w", "s")[0]).alias("gain"))
    return w.join(gain, ["gate", "th", "v"]).select("gate", "th", "v", "k", (F.col("re") / F.col("gain")).alias("re"), (F.col("im") / F.col("gain")).alias("im"))


def apply_filter(signal: DataFrame, weights: DataFrame, radar: Radar, received: int) -> DataFrame:
    """``gate, th, v, k, re, im``: filtered pulse trains."""
    part = weights.select("gate", "th", "v", (F.col("k") % radar.antennas).alias("ant"), F.expr(f"k div {radar.antennas}").alias("r"), "re", "im")
    met = signal.alias("s").join(part.alias("w"), ["gate", "ant"])
    place = (F.col("s.pulse") - F.col("w.r")).alias("k")
    sums = met.groupBy("gate", "w.th", "w.v", place).agg(*_summed(_times_conjugate("s", "w")))
    return sums.where(F.col("k").between(0, received - radar.pulses))


def integrate(trains: DataFrame, table: DataFrame) -> DataFrame:
    """``th, rg, v, re, im``: each train against the phases of its velocity."""
    met = trains.alias("t").join(broadcast_if_small(table).alias("d"), ["v", "k"])
    return met.groupBy("th", F.col("gate").alias("rg"), "v").agg(*_summed(_times_conjugate("t", "d")))


def _power(re: Column, im: Column) -> Column:
    return re * re + im * im


def mean_power(cube: DataFrame) -> DataFrame:
    return cube.groupBy("th").agg(F.avg(_power(F.col("re"), F.col("im"))).alias("power"))


def padded(cube: DataFrame, gates: int, velocities: int) -> DataFrame:
    """``cube`` moved inside a rim of half a detector window that holds the root of the angle's mean power."""
    rim_g, rim_v = (GATES - 1) // 2, (VELOCITIES - 1) // 2
    frame = _grid(cube.sparkSession, rg=gates + 2 * rim_g, v=velocities + 2 * rim_v)
    moved = cube.select("th", (F.col("rg") + rim_g).alias("rg"), (F.col("v") + rim_v).alias("v"), "re", "im")
    inside = F.col("rg").between(rim_g, gates + rim_g - 1) & F.col("v").between(rim_v, velocities + rim_v - 1)
    level = mean_power(cube).crossJoin(broadcast_if_small(frame.where(~inside)))
    return moved.unionByName(level.select("th", "rg", "v", F.sqrt("power").alias("re"), F.lit(0.0).alias("im")))


def detect(rim: DataFrame, gates: int, velocities: int) -> DataFrame:
    """``th, rg, v, re, im``: cells that no neighbour tops and that stand out, over the fourth root of mean power; others 0."""
    rim_g, rim_v = (GATES - 1) // 2, (VELOCITIES - 1) // 2
    offsets = [(g, w) for g in range(-rim_g, rim_g + 1) for w in range(-rim_v, rim_v + 1) if (g, w) != (0, 0)]
    around = F.broadcast(rim.sparkSession.createDataFrame(offsets, "g long, w long"))
    power = rim.withColumn("p", _power(F.col("re"), F.col("im")))
    sent = power.crossJoin(around).select("th", (F.col("rg") - F.col("g")).alias("rg"), (F.col("v") - F.col("w")).alias("v"), F.col("p").alias("q"))
    inside = F.col("rg").between(rim_g, gates + rim_g - 1) & F.col("v").between(rim_v, velocities + rim_v - 1)
    near = sent.where(inside).groupBy("th", "rg", "v").agg(F.max("q").alias("most"), F.sum("q").alias("all"))
    level = rim.where("rg = 0 and v = 0").select("th", F.col("re").alias("level"))
    met = power.where(inside).join(near, ["th", "rg", "v"]).join(F.broadcast(level), "th")
    stands = (F.col("p") >= F.col("most")) & (F.col("p") > OVER_POWER * F.col("level")) & (F.col("p") > OVER_NEIGHBOURS * F.col("all") / len(offsets))
    kept = [F.when(stands, F.col(c) / F.sqrt("level")).otherwise(0.0).alias(c) for c in ("re", "im")]
    return met.select("th", (F.col("rg") - rim_g).alias("rg"), (F.col("v") - rim_v).alias("v"), *kept)


def strongest_angle(cube: DataFrame) -> DataFrame:
    """The angle of greatest power of each gate and velocity stays, ties to the lowest; the others are 0."""
    order = Window.partitionBy("rg", "v").orderBy(_power(F.col("re"), F.col("im")).desc(), "th")
    ranked = cube.withColumn("place", F.row_number().over(order))
    return ranked.select("th", "rg", "v", *(F.when(F.col("place") == 1, F.col(c)).otherwise(0.0).alias(c) for c in ("re", "im")))


def correct_velocity(cube: DataFrame, radar: Radar) -> DataFrame:
    """Velocities without the platform's motion; of cells that fall together the one of the highest bin stays, empty bins are absent."""
    bearing = angle_of(F.col("th"), radar.angles, radar.beam_width) + math.radians(radar.beam_angle)
    own = velocity_of(F.col("v"), radar.velocities, radar.fastest) - radar.speed * F.cos(bearing)
    moved = cube.withColumn("to", velocity_bin(own, radar.velocities, radar.fastest))
    last = moved.groupBy("th", "rg", "to").agg(F.max_by(F.struct("re", "im"), "v").alias("c"))
    return last.select("th", "rg", F.col("to").alias("v"), "c.re", "c.im")


def detections(cube: DataFrame) -> DataFrame:
    """``rg, v, th, power`` of the first detections by gate, velocity and angle."""
    power = cube.select("rg", "v", "th", _power(F.col("re"), F.col("im")).alias("power"))
    return power.where(F.col("power") > LEAST_POWER).orderBy("rg", "v", "th").limit(MOST_DETECTIONS)


def unambiguous(plots: DataFrame, periods: DataFrame, velocities: int, wavelength: float) -> DataFrame:
    """``rg, v, th, power`` from ``burst, rg, v, th, power`` and ``burst, period``: targets that most bursts agree on.

    Each plot stands for the velocities that its burst cannot tell apart, on
    an axis of twice the bins. Local maxima of power survive if the bursts'
    hits there and around are at least four fifths of the bursts.
    """
    known = periods.agg(F.min("period"), F.count(F.lit(1))).first()
    fastest0, bursts = wavelength / (4 * known[0]), known[1]
    fastest = F.lit(wavelength) / (4 * F.col("period"))
    middle = (2.0 * F.col("v") + 1) * (fastest / velocities)
    own = F.when(F.col("v") >= velocities // 2, middle - 2 * fastest).otherwise(middle)
    spread = plots.join(F.broadcast(periods), "burst").withColumn("alias", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    spread = spread.withColumn("velocity", own + 2 * F.col("alias") * fastest).where(F.abs("velocity") < 2 * fastest0)
    cells = spread.select("rg", velocity_bin(F.col("velocity"), 2 * velocities, 2 * fastest0).alias("v"), "th", "power")
    cells = cells.groupBy("rg", "v", "th").agg(F.sum("power").alias("power"), F.count(F.lit(1)).alias("hits"))
    offsets = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
    around = F.broadcast(plots.sparkSession.createDataFrame(offsets, "a long, b long, c long"))
    sent = cells.crossJoin(around).select(
        (F.col("rg") + F.col("a")).alias("rg"), (F.col("v") + F.col("b")).alias("v"), (F.col("th") + F.col("c")).alias("th"), F.col("power").alias("p"), F.col("hits").alias("h")
    )
    near = sent.groupBy("rg", "v", "th").agg(F.max("p").alias("most"), F.sum("p").alias("more"), F.sum("h").alias("h"))
    met = cells.join(near, ["rg", "v", "th"], "left")
    good = (F.col("power") >= F.coalesce("most", F.lit(0.0))) & (F.col("hits") + F.coalesce("h", F.lit(0)) >= 0.8 * bursts)
    return met.where(good).select("rg", "v", "th", (F.col("power") + F.coalesce("more", F.lit(0.0))).alias("power"))


def burst(signal: DataFrame, radar: Radar, gates: int, received: int) -> DataFrame:
    """Detections of one burst ``ant, pulse, gate, re, im``, from compression to the list."""
    spark, taps = signal.sparkSession, chirp(signal.sparkSession)
    pressed = pulse_compression(signal, taps, gates)
    left = gates - len(CHIRP) + 1
    weights = filter_weights(inverses(covariance(pressed, radar, received)), steering(spark, radar))
    trains = apply_filter(pressed, weights, radar, received)
    cube = integrate(trains, doppler_table(spark, radar, received - radar.pulses + 1))
    found = strongest_angle(detect(padded(cube, left, radar.velocities), left, radar.velocities))
    return detections(correct_velocity(found, radar))
