"""Inputs and dumps of simulations in text files, each small enough for one task."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.particles import Box
from gridloom.sources.numbers import _counted, _lines, _numbers

#: Numbers of one radar burst: pulses, antennas, gates.
BURST = (32, 5, 95)


def whole(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


@dataclass(frozen=True)
class HeatInput:
    iterations: int
    resolution: int
    algorithm: int
    sources: DataFrame


def read_heat(spark: SparkSession, path: str) -> HeatInput:
    """Iterations, resolution, algorithm (0 Jacobi, 1 Gauss-Seidel, 2 red-black) and the sources; what follows the values of a line is a comment."""
    lines = [line.split() for line in whole(spark, path).splitlines() if line.strip()]
    iterations, resolution, algorithm, count = (int(line[0]) for line in lines[:4])
    sources = [tuple(float(x) for x in line[:4]) for line in lines[4 : 4 + count]]
    return HeatInput(iterations, resolution, algorithm, spark.createDataFrame(sources, "x double, y double, radius double, temperature double"))


def read_dump(spark: SparkSession, path: str, cutoff: float) -> tuple[DataFrame, Box, int]:
    """Particles ``id, m, x, y, z, vx, vy, vz``, their box and the time step of a dump; columns are found by name."""
    sections = re.split(r"(?m)^ITEM: ", whole(spark, path))[1:]
    found = {s.split("\n", 1)[0]: s.split("\n", 1)[1].splitlines() for s in sections}
    step = int(next(v for k, v in found.items() if k.startswith("TIMESTEP"))[0])
    bounds, edges = next((k, v) for k, v in found.items() if k.startswith("BOX BOUNDS"))
    flags = bounds.split()[2:5] or ["ff"] * 3
    low, high = zip(*((float(x) for x in line.split()[:2]) for line in edges[:3]), strict=True)
    atoms, rows = next((k, v) for k, v in found.items() if k.startswith("ATOMS"))
    names = [{"mass": "m"}.get(n, n) for n in atoms.split()[1:]]
    pdf = pd.DataFrame([r.split() for r in rows if r.strip()], columns=names).astype(float)
    pdf["id"] = pdf["id"].astype("int64")
    box = Box(low, tuple(b - a for a, b in zip(low, high, strict=True)), tuple(f == "pp" for f in flags), cutoff)
    return spark.createDataFrame(pdf[["id", "m", "x", "y", "z", "vx", "vy", "vz"]]), box, step


def write_dump(atoms: DataFrame, path: str, box: Box, step: int) -> None:
    """A dump with the particles in order of their ids."""
    head = [f"ITEM: TIMESTEP\n{step}", f"ITEM: NUMBER OF ATOMS\n{atoms.count()}", "ITEM: BOX BOUNDS " + " ".join("pp" if p else "ff" for p in box.periodic)]
    head += [f"{a} {a + s}" for a, s in zip(box.low, box.size, strict=True)] + ["ITEM: ATOMS id mass x y z vx vy vz"]
    first = atoms.sparkSession.createDataFrame([(-1, "\n".join(head))], "id long, value string")
    body = atoms.select("id", F.concat_ws(" ", "id", "m", "x", "y", "z", "vx", "vy", "vz").alias("value"))
    first.unionByName(body).repartitionByRange(1, "id").sortWithinPartitions("id").select("value").write.mode("overwrite").text(path)


def read_script(spark: SparkSession, path: str) -> dict:
    """The settings of a simulation script that matter here: ``cutoff, run, timestep, dump, pair_coeff``, those that it has."""
    found: dict = {}
    for line in whole(spark, path).splitlines():
        words = line.split("#")[0].split()
        if not words:
            continue
        if words[0] == "pair_style":
            found["cutoff"] = float(words[-1])
        elif words[0] == "run":
            found["run"] = int(words[1])
        elif words[0] == "timestep":
            found["timestep"] = float(words[1])
        elif words[0] in ("read_dump", "dump"):
            found["dump"] = words[1] if words[0] == "read_dump" else words[-1]
        elif words[0] == "pair_coeff":
            found["pair_coeff"] = tuple(float(x) for x in words[3:5])
    return found


def read_stimuli(spark: SparkSession, path: str, shape: tuple[int, int, int] = BURST) -> DataFrame:
    """``burst, period, pulse, ant, gate, re, im`` of bursts that each begin with ``Tr=``; lines are numbered where they are read."""
    lines = _lines(spark, path).where(F.col("line") != "")
    marked = lines.select("at", F.explode(F.split(F.regexp_replace("line", "Tr\\s*=\\s*", " Tr= "), "(?=Tr=)")).alias("line"))
    fields = marked.select("at", F.posexplode(F.filter(F.split("line", "\\s+"), lambda x: x != "")).alias("k", "text"))
    values = _counted(fields.select("at", "k", F.when(F.col("text") == "Tr=", F.lit(None)).otherwise(F.col("text")).cast("double").alias("x")))
    starts = values.where("x IS NULL").select(F.col("at").alias("start"))  # a row of each burst
    bursts = starts.select("start", (F.row_number().over(Window.orderBy("start")) - 1).cast("long").alias("burst"), F.lead("start").over(Window.orderBy("start")).alias("end"))
    inside = (F.col("at") > F.col("start")) & (F.col("end").isNull() | (F.col("at") < F.col("end")))
    placed = values.where("x IS NOT NULL").join(F.broadcast(bursts), inside).select("burst", (F.col("at") - F.col("start") - 1).alias("k"), "x")
    periods = placed.where("k = 0").select("burst", F.col("x").alias("period"))
    _, antennas, gates = shape
    pairs = placed.where("k > 0").groupBy("burst", F.expr("(k - 1) div 2").alias("n"))
    pairs = pairs.agg(F.max(F.when(F.col("k") % 2 == 1, F.col("x"))).alias("re"), F.max(F.when(F.col("k") % 2 == 0, F.col("x"))).alias("im"))
    place = [F.expr(f"n div {antennas * gates}").alias("pulse"), F.expr(f"n div {gates} % {antennas}").alias("ant"), (F.col("n") % gates).alias("gate")]
    return pairs.join(F.broadcast(periods), "burst").select("burst", "period", *place, "re", "im")


def read_mesh(spark: SparkSession, path: str, elements: int, nodes: int) -> tuple[DataFrame, DataFrame]:
    """Points ``elem, p, jacobian (9), kappa, mu, iglob`` and nodes ``iglob, rmass`` of a mesh database; nodes count from zero."""
    values = _numbers(spark, path)
    last = 1500 * elements
    own = values.where(F.col("at") < last).groupBy(F.expr("at div 12").alias("n")).agg(F.array_sort(F.collect_list(F.struct((F.col("at") % 12).alias("k"), "x"))).alias("f"))
    f = F.transform("f", lambda y: y["x"])
    points = own.select(
        F.expr("n div 125").alias("elem"), (F.col("n") % 125).alias("p"), F.slice(f, 1, 9).alias("jacobian"), f[9].alias("kappa"), f[10].alias("mu"),
        (f[11].cast("long") - 1).alias("iglob"),
    )
    masses = values.where(F.col("at").between(last, last + nodes - 1)).select((F.col("at") - last).alias("iglob"), F.col("x").alias("rmass"))
    return points, masses


def read_derivatives(spark: SparkSession, path: str, elements: int, nodes: int, points: int = 5) -> DataFrame:
    """``i, j, v``: the square derivative matrix that follows the masses of a mesh database, row by row."""
    first = 1500 * elements + nodes
    at = F.col("at") - first
    inside = _numbers(spark, path).where((at >= 0) & (at < points * points))
    return inside.select(F.expr(f"(at - {first}) div {points}").alias("i"), (at % points).alias("j"), F.col("x").alias("v"))


def write_plots(plots: DataFrame, path: str, gate_size: float) -> None:
    """Distance, velocity, angle and power of targets as CSV."""
    plots.select((F.col("rg") * gate_size).alias("distance"), "v", "th", "power").write.mode("overwrite").csv(path, header=True)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks ``level, bx, by, bz`` of an adaptive mesh as a list in one text file: their number, then a line for each."""
    order = ["level", "bx", "by", "bz"]
    head = blocks.sparkSession.createDataFrame([(-1, -1, -1, -1, str(blocks.count()))], "level int, bx long, by long, bz long, value string")
    lines = head.unionByName(blocks.select(F.col("level").cast("int").alias("level"), *(F.col(c).cast("long").alias(c) for c in order[1:]), F.concat_ws(" ", *order).alias("value")))
    lines.repartitionByRange(1, *order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)
