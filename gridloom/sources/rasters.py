"""Pictures: portable pixmaps in and out, uncompressed Targa out."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.shipping import ship


def parse_pixmap(data: bytes) -> pd.DataFrame:
    """``x, y, r, g, b`` of a P6 or P3 file; comments may stand in the header."""
    fields, at = [], 0
    while len(fields) < 4:
        match = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\S+)").match(data, at)
        fields.append(match[1])
        at = match.end()
    if fields[0] not in (b"P6", b"P3"):
        raise ValueError(f"not a colour pixmap: {fields[0]!r}")
    width, height = int(fields[1]), int(fields[2])
    if fields[0] == b"P6":
        values = np.frombuffer(data, dtype=np.uint8, count=3 * width * height, offset=at + 1)
    else:
        values = np.array(data[at:].split()[: 3 * width * height], dtype=np.int64)
    r, g, b = values.reshape(-1, 3).astype(np.int64).T
    n = np.arange(width * height)
    return pd.DataFrame({"x": n % width, "y": n // width, "r": r, "g": g, "b": b})


def read_pixmaps(spark: SparkSession, path: str) -> DataFrame:
    """``path, x, y, r, g, b`` of all pictures that match; one picture in one task."""
    ship(spark)

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                yield parse_pixmap(bytes(content)).assign(path=name)[["path", "x", "y", "r", "g", "b"]]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, x long, y long, r long, g long, b long")


def write_ascii_pixmap(pixels: DataFrame, path: str, width: int, height: int) -> None:
    """A P3 file of one line per row, written by Spark."""
    rows = pixels.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("x", "r", "g", "b"))).alias("p"))
    text = F.array_join(F.transform("p", lambda p: F.concat_ws(" ", p["r"], p["g"], p["b"])), " ")
    head = pixels.sparkSession.createDataFrame([(-1, f"P3\n{width} {height}\n255")], "y long, value string")
    whole = head.unionByName(rows.select(F.col("y").cast("long").alias("y"), text.alias("value")))
    whole.repartitionByRange(1, "y").sortWithinPartitions("y").select("value").write.mode("overwrite").text(path)


def _grouped(pixels: DataFrame, encode, schema: str) -> DataFrame:
    ship(pixels.sparkSession)
    return pixels.groupBy("path").applyInPandas(lambda pdf: pd.DataFrame({"path": [pdf.path.iloc[0]], "content": [encode(pdf)]}), schema)


def _raster(pdf: pd.DataFrame, order: str) -> tuple[int, int, bytes]:
    width, height = int(pdf.x.max()) + 1, int(pdf.y.max()) + 1
    out = np.zeros((height, width, 3), dtype=np.uint8)
    out[pdf.y, pdf.x] = pdf[list(order)].to_numpy()
    return width, height, out.tobytes()


def encode_pixmap(pdf: pd.DataFrame) -> bytes:
    width, height, data = _raster(pdf, "rgb")
    return f"P6\n{width} {height}\n255\n".encode() + data


def encode_targa(pdf: pd.DataFrame) -> bytes:
    """24 bits, blue first, from the top."""
    width, height, data = _raster(pdf, "bgr")
    head = bytearray(18)
    head[2], head[16], head[17] = 2, 24, 0x20
    head[12:16] = width.to_bytes(2, "little") + height.to_bytes(2, "little")
    return bytes(head) + data


def pixmap_files(pixels: DataFrame) -> DataFrame:
    """``path, content`` of a P6 file for each path of ``path, x, y, r, g, b``."""
    return _grouped(pixels, encode_pixmap, "path string, content binary")


def targa_files(pixels: DataFrame) -> DataFrame:
    return _grouped(pixels, encode_targa, "path string, content binary")
