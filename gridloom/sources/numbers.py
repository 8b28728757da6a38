"""Matrices and vectors in text files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.matrices import symmetric, zero_based
from gridloom.plans.shipping import ship


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``at, line``: numbers that grow along a single file, and its lines."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line"))


def _fields(lines: DataFrame) -> DataFrame:
    return lines.withColumn("f", F.split("line", "\\s+"))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, v`` from zero, of a real coordinate matrix; symmetric ones are expanded. Others are rejected."""
    lines = _lines(spark, path)
    banner = lines.orderBy("at").first()["line"].lower().split()
    if banner[:4] != ["%%matrixmarket", "matrix", "coordinate", "real"] or banner[4] not in ("symmetric", "general"):
        raise ValueError(f"not a real coordinate matrix: {' '.join(banner)}")
    body = lines.where(~F.col("line").startswith("%") & (F.col("line") != ""))
    sizes = body.orderBy("at").first()
    rows, columns, _ = map(int, sizes["line"].split())
    if banner[4] == "symmetric" and rows != columns:
        raise ValueError(f"a symmetric matrix of {rows} x {columns}")
    f = F.col("f")
    entries = _fields(body.where(F.col("at") > sizes["at"])).select(f[0].cast("long").alias("i"), f[1].cast("long").alias("j"), f[2].cast("double").alias("v"))
    matrix = zero_based(entries)
    return symmetric(matrix) if banner[4] == "symmetric" else matrix


def write_matrix_market(a: DataFrame, path: str, rows: int, columns: int) -> None:
    """One text file with banner, sizes and entries in order of columns."""
    head = a.sparkSession.createDataFrame(
        [(-2, 0, "%%MatrixMarket matrix coordinate real general"), (-1, 0, f"{rows} {columns} {a.count()}")], "j long, i long, value string"
    )
    body = a.select("j", "i", F.format_string("%d %d %s", F.col("i") + 1, F.col("j") + 1, F.col("v").cast("string")).alias("value"))
    head.unionByName(body).repartitionByRange(1, "j", "i").sortWithinPartitions("j", "i").select("value").write.mode("overwrite").text(path)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """``i, x``: one number a line, of one file."""
    lines = _lines(spark, path).where(F.col("line") != "").select("at", F.lit(0).alias("k"), F.col("line").cast("double").alias("x"))
    return _counted(lines).withColumnRenamed("at", "i")


def read_dense(spark: SparkSession, path: str, n: int) -> tuple[DataFrame, float]:
    """``i, j, v`` of n * n numbers row by row, and the checksum after them."""
    values = _numbers(spark, path)
    matrix = values.where(F.col("at") < n * n).select(F.expr(f"at div {n}").alias("i"), (F.col("at") % n).alias("j"), F.col("x").alias("v"))
    return matrix, values.where(F.col("at") == n * n).first()["x"]


def read_sized(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, v`` of ``M N`` and then M * N numbers row by row."""
    values = _numbers(spark, path)
    columns = int(values.where(F.col("at") == 1).first()["x"])
    at = F.col("at") - 2
    return values.where(at >= 0).select(F.expr(f"(at - 2) div {columns}").alias("i"), (at % columns).alias("j"), F.col("x").alias("v"))


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    """``at, x``: all numbers of a file in order."""
    found = _fields(_lines(spark, path).where(F.col("line") != "")).select("at", F.posexplode("f").alias("k", "text"))
    return _counted(found.select("at", "k", F.col("text").cast("double").alias("x")))


def _counted(found: DataFrame) -> DataFrame:
    """``at, x`` of ``at, k, x`` with gapless numbers in their order, part by part of the file."""
    part = F.shiftright("at", 33)  # where _lines counts them
    inside = Window.partitionBy(part).orderBy("at", "k")
    sizes = found.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # a row of each part
    ranked = found.select(part.alias("part"), (F.row_number().over(inside) - 1).alias("r"), "x")
    return ranked.join(F.broadcast(starts), "part").select((F.col("start") + F.col("r")).cast("long").alias("at"), "x")


def fortran_fields(line: str, form: str) -> list[str]:
    """Fields of fixed width by a format such as (4E20.12) or (16I5)."""
    match = re.search(r"(\d+)\s*[IEDFGiedfg]\s*(\d+)", form)
    width = int(match[2])
    return [x for x in (line[k : k + width].strip() for k in range(0, len(line.rstrip("\n")), width)) if x]


def parse_boeing(text: str) -> pd.DataFrame:
    """Entries from zero of a compressed-column file of either Boeing layout; the stored half only."""
    lines = text.splitlines()
    counts = [int(x) for x in lines[1].split()]
    rows, columns, entries = (int(x) for x in lines[2][3:].split()[:3])
    forms = re.findall(r"\([^)]*\)", lines[3])
    at = 5 if len(counts) == 5 and counts[4] > 0 else 4
    parts = []
    for form, take in zip(forms, counts[1:4], strict=False):
        parts.append([x for line in lines[at : at + take] for x in fortran_fields(line, form)])
        at += take
    starts, where = [int(x) for x in parts[0]], [int(x) - 1 for x in parts[1]]
    values = [float(x.replace("D", "E").replace("d", "e")) for x in parts[2]]
    j = [c for c in range(columns) for _ in range(starts[c + 1] - starts[c])]
    if len(j) != entries or max(where) >= rows:
        raise ValueError("the column pointers do not fit the sizes")
    return pd.DataFrame({"i": where, "j": j, "v": values})


def read_boeing(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, v`` of Boeing files, each parsed in one task; symmetric ones are expanded by the caller."""
    ship(spark)

    def run(batches):
        for pdf in batches:
            for text in pdf["value"]:
                yield parse_boeing(text)

    return spark.read.text(path, wholetext=True).mapInPandas(run, "i long, j long, v double")


def _text(rows: DataFrame, order: list[str], value, path: str) -> None:
    """One file with a line for each row, in order."""
    lines = rows.select(*order, value.alias("value")).repartitionByRange(1, *order).sortWithinPartitions(*order)
    lines.select("value").write.mode("overwrite").text(path)


def write_vector(x: DataFrame, path: str) -> None:
    """One number a line."""
    _text(x, ["i"], F.col("x").cast("string"), path)


def write_sized(a: DataFrame, path: str, rows: int, columns: int) -> None:
    """``M N`` and then all numbers row by row, a row a line; the form of factors Q and R."""
    cells = a.sparkSession.range(rows * columns).select(F.expr(f"id div {columns}").alias("i"), (F.col("id") % columns).alias("j"))
    full = cells.join(a, ["i", "j"], "left").select("i", F.struct("j", F.coalesce("v", F.lit(0.0)).alias("v")).alias("c"))
    lines = full.groupBy("i").agg(F.array_sort(F.collect_list("c")).alias("c")).select("i", F.array_join(F.transform("c", lambda c: c["v"].cast("string")), " ").alias("value"))
    head = a.sparkSession.createDataFrame([(-1, f"{rows} {columns}")], "i long, value string")
    _text(head.unionByName(lines), ["i"], F.col("value"), path)


def write_digests(digests: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """One digest a line, in order of the ids."""
    _text(digests, [id_col], F.col("md5"), path)


def write_log(steps: DataFrame, path: str) -> None:
    """``step residual`` of each step of a solver, a step a line."""
    _text(steps, ["step"], F.concat_ws(" ", F.col("step").cast("string"), F.col("residual").cast("string")), path)


def boeing_text(rows: int, columns: int, entries: pd.DataFrame, title: str, key: str = "KEY") -> str:
    """A real unsymmetric assembled matrix by compressed columns, in lines of fixed fields."""
    entries = entries.sort_values(["j", "i"])
    starts = [1, *(int(n) + 1 for n in entries.groupby("j").size().reindex(range(columns), fill_value=0).cumsum())]

    def block(values: list[str], width: int) -> list[str]:
        per_line = 80 // width
        return ["".join(v.rjust(width) for v in values[k : k + per_line]) for k in range(0, len(values), per_line)]

    parts = [block([str(x) for x in starts], 10), block([str(int(i) + 1) for i in entries.i], 10), block([f"{v:.12E}" for v in entries.v], 20)]
    counts = [len(p) for p in parts]
    head = [
        f"{title[:72]:<72}{key[:8]:<8}", "".join(f"{x:14d}" for x in (sum(counts), *counts)),
        f"{'RUA':<14}" + "".join(f"{x:14d}" for x in (rows, columns, len(entries), 0)), f"{'(8I10)':<16}{'(8I10)':<16}{'(4E20.12)':<20}",
    ]
    return "\n".join([*head, *(line for part in parts for line in part)])


def write_boeing(a: DataFrame, path: str, rows: int, columns: int, title: str = "matrix") -> None:
    """One Boeing file; its layout needs all columns in order, so one task holds the entries."""
    ship(a.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"value": [boeing_text(rows, columns, pdf, title)]})

    whole = a.select(F.lit(0).alias("one"), "i", "j", "v").groupBy("one").applyInPandas(run, "value string")
    whole.coalesce(1).write.mode("overwrite").text(path)
