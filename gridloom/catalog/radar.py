"""Radar queries on formula cubes and, for the whole chain, on ``events``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.catalog.tables import table
from gridloom.operators import radar as r

RADAR = r.Radar(angles=4, velocities=4, pulses=2, antennas=2)
GATES_IN, RECEIVED = 20, 6


def _signal(spark):
    cells = r._grid(spark, ant=RADAR.antennas, pulse=RECEIVED, gate=GATES_IN)
    a, p, g = F.col("ant"), F.col("pulse"), F.col("gate")
    return cells.select("ant", "pulse", "gate", ((a * 7 + p * 5 + g * 3) % 11 - 5.0).alias("re"), ((a * 3 + p * 7 + g * 5) % 13 - 6.0).alias("im"))


def _cube(spark, gates=12):
    cells = r._grid(spark, th=RADAR.angles, rg=gates, v=RADAR.velocities)
    t, g, v = F.col("th"), F.col("rg"), F.col("v")
    peak = F.when((g % 9 == 4) & (v == 2), 4000.0 + t).otherwise(0.0)
    return cells.select("th", "rg", "v", ((t * 7 + g * 5 + v * 3) % 11 - 5.0 + peak).alias("re"), ((t * 3 + g * 7 + v * 5) % 13 - 6.0).alias("im"))


def _rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


def chirp_taps(spark, sf_dir):
    return r.chirp(spark)


def steering_vectors(spark, sf_dir):
    return _rounded(r.steering(spark, RADAR), "re", "im")


def doppler_phases(spark, sf_dir):
    return _rounded(r.doppler_table(spark, RADAR, 5), "re", "im")


def velocity_bins(spark, sf_dir):
    bins = spark.range(20).select(F.col("id").alias("v"), r.velocity_of(F.col("id"), 20, 15.0).alias("velocity"))
    return bins.select("v", F.round("velocity", 6).alias("velocity"), r.velocity_bin(F.col("velocity"), 20, 15.0).alias("back"))


def pulse_compression(spark, sf_dir):
    return _rounded(r.pulse_compression(_signal(spark), r.chirp(spark), GATES_IN), "re", "im")


def space_time_covariance(spark, sf_dir):
    return _rounded(r.covariance(_signal(spark), RADAR, RECEIVED), "re", "im")


def covariance_inverse(spark, sf_dir):
    """Product with its matrix: the identity."""
    a = r.covariance(_signal(spark), RADAR, RECEIVED)
    met = a.alias("a").join(r.inverses(a).alias("b"), (F.col("a.gate") == F.col("b.gate")) & (F.col("a.j") == F.col("b.i")))
    return _rounded(met.groupBy(F.col("a.gate"), F.col("a.i"), F.col("b.j")).agg(*r._summed(r._times("a", "b"))), "re", "im", places=4)


def filter_gain(spark, sf_dir):
    """Every filter passes its own target unchanged."""
    vectors = r.steering(spark, RADAR)
    weights = r.filter_weights(r.inverses(r.covariance(_signal(spark), RADAR, RECEIVED)), vectors)
    met = weights.alias("w").join(vectors.alias("s"), ["th", "v", "k"])
    gain = met.groupBy("gate", "th", "v").agg(F.sum(r._times("w", "s")[0]).alias("gain"))
    return _rounded(gain, "gain", places=4)


def doppler_integration(spark, sf_dir):
    trains = r._grid(spark, gate=3, th=2, v=4, k=5)
    trains = trains.select("*", (F.col("gate") + F.col("k") - 2.0).alias("re"), (F.col("th") * 2.0 - F.col("k")).alias("im"))
    return _rounded(r.integrate(trains, r.doppler_table(spark, RADAR, 5)), "re", "im")


def mean_angle_power(spark, sf_dir):
    return _rounded(r.mean_power(_cube(spark)), "power")


def padded_cube(spark, sf_dir):
    return _rounded(r.padded(_cube(spark), 12, 4), "re", "im")


def cfar_detection(spark, sf_dir):
    return _rounded(r.detect(r.padded(_cube(spark), 12, 4), 12, 4), "re", "im")


def strongest_angle(spark, sf_dir):
    return r.strongest_angle(_cube(spark))


def corrected_velocity(spark, sf_dir):
    return r.correct_velocity(_cube(spark), RADAR)


def detection_list(spark, sf_dir):
    return r.detections(_cube(spark))


def ambiguity_removal(spark, sf_dir):
    cells = r._grid(spark, burst=3, rg=6, th=5)
    plots = cells.where("(rg + th + burst) % 3 <> 0").select("burst", "rg", ((F.col("rg") + F.col("th")) % 4).alias("v"), "th", (F.col("rg") * 10.0 + F.col("th") + F.col("burst")).alias("power"))
    periods = spark.createDataFrame([(0, 0.0005), (1, 0.00055), (2, 0.0006)], "burst long, period double")
    return _rounded(r.unambiguous(plots, periods, 4, 0.03), "power")


#: Gate, angle and velocity bin of the planted target, and its amplitude.
TARGET, AMPLITUDE = (4, 2, 3), 1e4


def _echo(spark):
    """What a target of TARGET sends back: the chirp at its gate, with its phases at each antenna and pulse."""
    gate, th, v = TARGET
    taps = r.chirp(spark).select("tap", F.col("re").alias("w"))
    bearing = F.lit(math.radians(RADAR.beam_angle)) + r.angle_of(F.lit(th), RADAR.angles, RADAR.beam_width)
    wave = 2 * math.pi / RADAR.wavelength
    velocity = r.velocity_of(F.lit(v), RADAR.velocities, RADAR.fastest)
    cells = r._grid(spark, ant=RADAR.antennas, pulse=RECEIVED).crossJoin(F.broadcast(taps))
    phase = wave * RADAR.spacing * F.col("ant") * F.cos(bearing) - 2 * wave * velocity * RADAR.period * F.col("pulse")
    strong = F.col("w") * AMPLITUDE
    return cells.select("ant", "pulse", (F.col("tap") + gate).alias("gate"), (strong * F.cos(phase)).alias("re"), (strong * F.sin(phase)).alias("im"))


def _burst_signal(spark, sf_dir):
    """All events' values, their means in the cells of a burst by their number, around the echo of one target."""
    n = RADAR.antennas * RECEIVED * 24
    at = F.col("event_id") % n
    noise = table(spark, sf_dir, "events").select(
        F.expr(f"event_id % {n} div {RECEIVED * 24}").alias("ant"), F.expr(f"event_id % {n} div 24 % {RECEIVED}").alias("pulse"), (at % 24).alias("gate"),
        F.col("value").alias("re"), (F.col("value") * ((F.col("event_id") % 7) - 3)).alias("im"),
    )
    noise = noise.groupBy("ant", "pulse", "gate").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    return noise.unionByName(_echo(spark)).groupBy("ant", "pulse", "gate").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def radar_burst(spark, sf_dir):
    """The whole chain on all events and a planted target."""
    return _rounded(r.burst(_burst_signal(spark, sf_dir), RADAR, 24, RECEIVED), "power", places=3)


def radar_target(spark, sf_dir):
    """Gate and angle of the strongest detection: the target's."""
    found = r.burst(_burst_signal(spark, sf_dir), RADAR, 24, RECEIVED)
    return found.agg(F.max_by(F.struct("rg", "th"), "power").alias("t")).select("t.rg", "t.th")


def filtered_target(spark, sf_dir):
    """The filter of the target's angle and velocity passes an echo without noise as it is; where nothing is, it gives nothing."""
    cells = _echo(spark).where(F.col("gate") == TARGET[0] + 3)
    weights = r.steering(spark, RADAR).where((F.col("th") == TARGET[1]) & (F.col("v") == TARGET[2])).withColumn("gate", F.lit(TARGET[0] + 3).cast("long"))
    n = RADAR.antennas * RADAR.pulses
    even = weights.select("gate", "th", "v", "k", (F.col("re") / n).alias("re"), (F.col("im") / n).alias("im"))
    trains = r.apply_filter(cells, even, RADAR, RECEIVED)
    power = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / AMPLITUDE
    return trains.select("gate", "th", "v", "k", F.round(power, 3).alias("gain"))


QUERIES = {
    f.__name__: f
    for f in (
        chirp_taps, steering_vectors, doppler_phases, velocity_bins, pulse_compression, space_time_covariance, covariance_inverse, filter_gain,
        doppler_integration, mean_angle_power, padded_cube, cfar_detection, strongest_angle, corrected_velocity, detection_list,
        ambiguity_removal, radar_burst, radar_target, filtered_target,
    )
}

_SIG = f"""sg AS (SELECT ant, pulse, gate, CAST((ant * 7 + pulse * 5 + gate * 3) % 11 - 5 AS DOUBLE) AS re, CAST((ant * 3 + pulse * 7 + gate * 5) % 13 - 6 AS DOUBLE) AS im
FROM range({RADAR.antennas}) a(ant), range({RECEIVED}) p(pulse), range({GATES_IN}) g(gate))"""
_CUBE = """cu AS (SELECT th, rg, v, CAST((th * 7 + rg * 5 + v * 3) % 11 - 5 AS DOUBLE) + CASE WHEN rg % 9 = 4 AND v = 2 THEN 4000.0::DOUBLE + th ELSE 0 END AS re,
CAST((th * 3 + rg * 7 + v * 5) % 13 - 6 AS DOUBLE) AS im FROM range(4) a(th), range(12) b(rg), range(4) c(v))"""
_TAPS = "tp AS (SELECT * FROM (VALUES " + ", ".join(f"({j}, {c!r}::DOUBLE)" for j, c in enumerate(r.CHIRP)) + ") t(tap, w))"
_V = f"CASE WHEN v >= 2 THEN (2.0 * v + 1) * {RADAR.fastest / 4!r}::DOUBLE - {2 * RADAR.fastest!r}::DOUBLE ELSE (2.0 * v + 1) * {RADAR.fastest / 4!r}::DOUBLE END"
_TURN = f"{4 * math.pi * RADAR.period / RADAR.wavelength!r}::DOUBLE * k * ({_V})"
_RIM = f"""{_CUBE}, mp AS (SELECT th, avg(re * re + im * im) AS power FROM cu GROUP BY th),
fr AS (SELECT a.rg, b.v FROM range(18) a(rg), range(8) b(v) WHERE NOT (a.rg BETWEEN 3 AND 14 AND b.v BETWEEN 2 AND 5)),
rim AS (SELECT th, rg + 3 AS rg, v + 2 AS v, re, im FROM cu UNION ALL SELECT th, rg, v, sqrt(power), 0 FROM mp, fr)"""
_BEAM = math.radians(RADAR.beam_angle)
_DIR = f"""{_BEAM!r}::DOUBLE + {math.radians(RADAR.beam_width)!r}::DOUBLE * (-0.5 + (2.0 * th + 1) / 8.0)
 + ({RADAR.spacing} * ant - {RADAR.speed * RADAR.period} * pulse) * {math.sin(_BEAM) / RADAR.distance!r}::DOUBLE"""
_WAVE = 2 * math.pi / RADAR.wavelength
_PHASE = f"{_WAVE * RADAR.spacing!r}::DOUBLE * ant * cos({_DIR}) - {2 * _WAVE * RADAR.period!r}::DOUBLE * ({_V}) * pulse"

ORACLE_SQL = {
    "chirp_taps": f"WITH {_TAPS} SELECT CAST(tap AS BIGINT) AS tap, w AS re, CAST(0 AS DOUBLE) AS im FROM tp",
    "steering_vectors": f"""SELECT th, v, ant + {RADAR.antennas} * pulse AS k, round(cos({_PHASE}), 6) + 0.0 AS re, round(sin({_PHASE}), 6) + 0.0 AS im
FROM range(4) a(th), range(4) b(v), range({RADAR.pulses}) c(pulse), range({RADAR.antennas}) d(ant)""",
    "doppler_phases": f"SELECT v, k, round(cos({_TURN}), 6) + 0.0 AS re, round(-sin({_TURN}), 6) + 0.0 AS im FROM range(4) a(v), range(5) b(k)",
    "velocity_bins": "SELECT v, round((2.0 * v + 1) * 0.75::DOUBLE - CASE WHEN v >= 10 THEN 30 ELSE 0 END, 6) AS velocity, v AS back FROM range(20) t(v)",
    "pulse_compression": f"""WITH {_SIG}, {_TAPS} SELECT ant, pulse, gate - tap AS gate, round(sum(re * w), 6) + 0.0 AS re, round(sum(im * w), 6) + 0.0 AS im
FROM sg, tp WHERE gate - tap BETWEEN 0 AND {GATES_IN - 16} GROUP BY 1, 2, 3""",
    "space_time_covariance": f"""WITH {_SIG}, w AS (SELECT gate, pulse - r AS l, ant + 2 * r AS k, re, im FROM sg, range(2) t(r) WHERE pulse - r BETWEEN 0 AND {RECEIVED - 2})
SELECT a.gate, a.k AS i, b.k AS j, round(sum(a.re * b.re + a.im * b.im), 6) + 0.0 AS re, round(sum(a.im * b.re - a.re * b.im), 6) + 0.0 AS im
FROM w a JOIN w b USING (gate, l) GROUP BY 1, 2, 3""",
    "covariance_inverse": f"SELECT gate, i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END AS re, CAST(0 AS DOUBLE) AS im FROM range({GATES_IN}) a(gate), range(4) b(i), range(4) c(j)",
    "filter_gain": f"SELECT gate, th, v, CAST(1 AS DOUBLE) AS gain FROM range({GATES_IN}) a(gate), range(4) b(th), range(4) c(v)",
    "doppler_integration": f"""WITH t AS (SELECT gate, th, v, k, gate + k - 2.0::DOUBLE AS re, th * 2.0::DOUBLE - k AS im, cos({_TURN}) AS c, -sin({_TURN}) AS s
  FROM range(3) a(gate), range(2) b(th), range(4) d(v), range(5) e(k))
SELECT th, gate AS rg, v, round(sum(re * c + im * s), 6) + 0.0 AS re, round(sum(im * c - re * s), 6) + 0.0 AS im FROM t GROUP BY th, gate, v""",
    "mean_angle_power": f"WITH {_CUBE} SELECT th, round(avg(re * re + im * im), 6) + 0.0 AS power FROM cu GROUP BY th",
    "padded_cube": f"WITH {_RIM} SELECT th, rg, v, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM rim",
    "cfar_detection": f"""WITH {_RIM}, p AS (SELECT *, re * re + im * im AS p FROM rim),
n AS (SELECT a.th, a.rg, a.v, a.re, a.im, a.p, max(b.p) AS most, sum(b.p) AS s FROM p a JOIN p b ON a.th = b.th AND abs(a.rg - b.rg) <= 3 AND abs(a.v - b.v) <= 2
  AND NOT (a.rg = b.rg AND a.v = b.v) WHERE a.rg BETWEEN 3 AND 14 AND a.v BETWEEN 2 AND 5 GROUP BY ALL),
k AS (SELECT n.*, sqrt(power) AS lv FROM n JOIN mp USING (th))
SELECT th, rg - 3 AS rg, v - 2 AS v, round(CASE WHEN p >= most AND p > 10000 * lv AND p > 10 * s / 34 THEN re / sqrt(lv) ELSE 0 END, 6) + 0.0 AS re,
round(CASE WHEN p >= most AND p > 10000 * lv AND p > 10 * s / 34 THEN im / sqrt(lv) ELSE 0 END, 6) + 0.0 AS im FROM k""",
    "strongest_angle": f"""WITH {_CUBE}, k AS (SELECT *, row_number() OVER (PARTITION BY rg, v ORDER BY re * re + im * im DESC, th) AS n FROM cu)
SELECT th, rg, v, CASE WHEN n = 1 THEN re ELSE 0 END AS re, CASE WHEN n = 1 THEN im ELSE 0 END AS im FROM k""",
    "corrected_velocity": f"""WITH {_CUBE}, o AS (SELECT *, {_V} - {RADAR.speed}::DOUBLE * cos({math.radians(RADAR.beam_width)!r}::DOUBLE * (-0.5 + (2.0 * th + 1) / 8.0) + {_BEAM!r}::DOUBLE) AS w FROM cu),
b AS (SELECT th, rg, v, re, im, CAST(least(greatest(floor(1e-5 + CASE WHEN w >= 0 THEN w ELSE w + {2 * RADAR.fastest!r}::DOUBLE END / {RADAR.fastest / 2!r}::DOUBLE), 0), 3) AS BIGINT) AS n FROM o)
SELECT th, rg, n AS v, arg_max(re, v) AS re, arg_max(im, v) AS im FROM b GROUP BY th, rg, n""",
    "detection_list": f"WITH {_CUBE} SELECT rg, v, th, re * re + im * im AS power FROM cu WHERE re * re + im * im > 1e-5 ORDER BY rg, v, th LIMIT 100",
    "ambiguity_removal": """WITH pl AS (SELECT burst, rg, (rg + th) % 4 AS v, th, rg * 10.0::DOUBLE + th + burst AS power FROM range(3) a(burst), range(6) b(rg), range(5) c(th) WHERE (rg + th + burst) % 3 <> 0),
pe(burst, period) AS (VALUES (0, 0.0005::DOUBLE), (1, 0.00055::DOUBLE), (2, 0.0006::DOUBLE)),
f AS (SELECT burst, 0.03::DOUBLE / (4 * period) AS f FROM pe), f0 AS (SELECT max(f) AS f0 FROM f),
s AS (SELECT rg, th, power, (2.0 * v + 1) * (f / 4) - CASE WHEN v >= 2 THEN 2 * f ELSE 0 END + 2 * k * f AS w, f0 FROM pl JOIN f USING (burst), f0, range(-2, 3) t(k)),
b AS (SELECT rg, th, power, CAST(least(greatest(floor(1e-5 + CASE WHEN w >= 0 THEN w ELSE w + 4 * f0 END / (4 * f0 / 8)), 0), 7) AS BIGINT) AS v FROM s WHERE abs(w) < 2 * f0),
c AS (SELECT rg, v, th, sum(power) AS power, count(*) AS hits FROM b GROUP BY rg, v, th),
n AS (SELECT x.rg, x.v, x.th, max(y.power) AS most, sum(y.power) AS more, sum(y.hits) AS h FROM c x JOIN c y
  ON abs(x.rg - y.rg) <= 1 AND abs(x.v - y.v) <= 1 AND abs(x.th - y.th) <= 1 AND NOT (x.rg = y.rg AND x.v = y.v AND x.th = y.th) GROUP BY 1, 2, 3)
SELECT c.rg, c.v, c.th, round(c.power + coalesce(more, 0), 6) + 0.0 AS power FROM c LEFT JOIN n USING (rg, v, th)
WHERE c.power >= coalesce(most, 0) AND hits + coalesce(h, 0) >= 0.8 * 3""",
    "radar_target": f"SELECT CAST({TARGET[0]} AS BIGINT) AS rg, CAST({TARGET[1]} AS BIGINT) AS th",
    "filtered_target": f"""SELECT CAST({TARGET[0] + 3} AS BIGINT) AS gate, CAST({TARGET[1]} AS BIGINT) AS th, CAST({TARGET[2]} AS BIGINT) AS v, k,
round(abs({r.CHIRP[3]!r}::DOUBLE), 3) AS gain FROM range({RECEIVED - RADAR.pulses + 1}) t(k)""",
}
