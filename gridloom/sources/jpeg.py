"""Baseline JPEG files: headers, entropy-coded data, and pixels by DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.images import from_ycbcr, inverse_dct
from gridloom.plans.shipping import ship

#: Markers.
START, END, BASELINE, HUFFMAN, QUANTISERS, SCAN, RESTARTS = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDA, 0xDD
UNSUPPORTED = (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)

#: Natural place of each coefficient in the order of the file: along diagonals, turning at each end.
ZIGZAG = [
    8 * y + x
    for d in range(15)
    for y, x in ([(d - x, x) for x in range(8) if 0 <= d - x < 8] if d % 2 == 0 else [(y, d - y) for y in range(8) if 0 <= d - y < 8])
]


@dataclass
class Component:
    number: int
    across: int
    down: int
    quantiser: int
    dc: int = 0
    ac: int = 0


@dataclass
class Header:
    width: int = 0
    height: int = 0
    restart: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[tuple[int, int], dict[tuple[int, int], int]] = field(default_factory=dict)
    data: int = 0


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """Symbols by (length, code); codes of a length follow each other and double with the length."""
    found, code, at = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for symbol in symbols[at : at + count]:
            found[length, code] = symbol
            code += 1
        at += count
        code <<= 1
    return found


def parse_header(data: bytes) -> Header:
    """All segments up to the scan. Only baseline pictures of one or three components pass."""
    if data[:2] != bytes([0xFF, START]):
        raise ValueError("not a JPEG file")
    header, at = Header(), 2
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker in UNSUPPORTED:
            raise ValueError(f"only baseline files are read, not frame type {marker:#x}")
        if marker == QUANTISERS:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], dtype=">u2" if wide else "u1").astype(np.int64)
                header.quantisers[body[0] & 15] = values
                body = body[1 + 64 * (1 + wide) :]
        elif marker == HUFFMAN:
            while body:
                total = sum(body[1:17])
                header.codes[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == BASELINE:
            header.height, header.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            header.components = [Component(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * k : 9 + 3 * k] for k in range(body[5]))]
            if len(header.components) not in (1, 3):
                raise ValueError(f"a picture of {len(header.components)} components")
        elif marker == RESTARTS:
            header.restart = int.from_bytes(body[:2], "big")
        elif marker == SCAN:
            for k in range(body[0]):
                component = next(c for c in header.components if c.number == body[1 + 2 * k])
                component.dc, component.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
            header.data = at
            return header


def restart_segments(data: bytes, start: int) -> list[bytes]:
    """Entropy-coded data between restart markers, without stuffed zeros."""
    segments, begin, at = [], start, start
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*segments, data[begin:].replace(b"\xff\x00", b"\xff")]
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            segments.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
            begin = at = at + 2
        else:
            return [*segments, data[begin:at].replace(b"\xff\x00", b"\xff")]


class Bits:
    """Bits of a segment from the highest; ones follow the end."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data + b"\xff" * 8, "big"), 8 * len(data) + 64

    def take(self, n: int) -> int:
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        """A number of ``n`` bits; a leading zero means negative."""
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def decode(data: bytes) -> pd.DataFrame:
    """``comp, bx, by, k, c, q``: coefficients that are not zero (and all of place 0), with their quantisers."""
    header = parse_header(data)
    across, down = max(c.across for c in header.components), max(c.down for c in header.components)
    units_x, units_y = -(-header.width // (8 * across)), -(-header.height // (8 * down))
    segments, rows = restart_segments(data, header.data), []
    per_segment = header.restart or units_x * units_y
    for number, segment in enumerate(segments):
        bits, before = Bits(segment), dict.fromkeys(range(len(header.components)), 0)
        for unit in range(number * per_segment, min((number + 1) * per_segment, units_x * units_y)):
            for comp, c in enumerate(header.components):
                q = header.quantisers[c.quantiser]
                for inner in range(c.across * c.down):
                    bx, by = unit % units_x * c.across + inner % c.across, unit // units_x * c.down + inner // c.across
                    before[comp] += bits.signed(bits.symbol(header.codes[0, c.dc]))
                    rows.append((comp, bx, by, 0, before[comp], int(q[0])))
                    at = 1
                    while at < 64:
                        run, size = divmod(bits.symbol(header.codes[1, c.ac]), 16)
                        if not size:
                            if run < 15:
                                break
                            at += 16
                            continue
                        at += run
                        rows.append((comp, bx, by, ZIGZAG[at], bits.signed(size), int(q[at])))
                        at += 1
    return pd.DataFrame(rows, columns=["comp", "bx", "by", "k", "c", "q"])


def read_jpeg(spark: SparkSession, path: str) -> DataFrame:
    """``path, width, height, across, down, comp, bx, by, k, c, q`` of all files that match; a file is decoded in one task.

    ``across`` and ``down`` say how many picture samples a component's sample covers.
    """
    ship(spark)

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                header = parse_header(bytes(content))
                most = max(c.across for c in header.components), max(c.down for c in header.components)
                out = decode(bytes(content)).assign(path=name, width=header.width, height=header.height)
                out["across"] = out.comp.map({i: most[0] // c.across for i, c in enumerate(header.components)})
                out["down"] = out.comp.map({i: most[1] // c.down for i, c in enumerate(header.components)})
                yield out[["path", "width", "height", "across", "down", "comp", "bx", "by", "k", "c", "q"]]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    longs = ("width", "height", "across", "down", "comp", "bx", "by", "k", "c", "q")
    return files.mapInPandas(run, "path string, " + ", ".join(f"{c} long" for c in longs))


def jpeg_pixels(coefficients: DataFrame) -> DataFrame:
    """``path, x, y, b, g, r``: dequantised, transformed, spread over the samples they cover, and converted."""
    named = coefficients.withColumn("block", F.struct("path", "width", "height", "across", "down", "comp", "bx", "by"))
    scaled = named.select("block", "k", (F.col("c") * F.col("q")).cast("double").alias("c"))
    ones = coefficients.sparkSession.range(64).select(F.col("id").alias("k"), F.lit(1.0).alias("q"))
    samples = inverse_dct(scaled, ones).select("block.*", "place", "value")
    left = (F.col("bx") * 8 + F.col("place") % 8) * F.col("across")
    top = (F.col("by") * 8 + F.expr("place div 8")) * F.col("down")
    spread = samples.select(
        "path", "width", "height", "comp", "value", left.alias("left"), top.alias("top"),
        F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("dx"), "down",
    ).select("*", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("dy"))
    placed = spread.select("path", "width", "height", (F.col("left") + F.col("dx")).alias("x"), (F.col("top") + F.col("dy")).alias("y"), "comp", "value")
    inside = placed.where((F.col("x") < F.col("width")) & (F.col("y") < F.col("height")))
    values = [F.max(F.when(F.col("comp") == i, F.col("value"))) for i in range(3)]
    grey = F.lit(128)
    pixels = inside.groupBy("path", "x", "y").agg(values[0].alias("luma"), F.coalesce(values[1], grey).alias("cb"), F.coalesce(values[2], grey).alias("cr"))
    converted = from_ycbcr(pixels.select(F.struct("path", "x").alias("x"), "y", "luma", "cb", "cr"))
    return converted.select("x.path", "x.x", "y", "b", "g", "r")
