"""Round trips of the file formats."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.catalog import dense, particles
from gridloom.operators.particles import Box
from gridloom.sources import numbers, rasters, simulations


def entries(frame):
    return sorted((r.i, r.j, round(r.v, 9)) for r in frame.collect())


def test_matrix_market(spark, tmp_path):
    a = dense.lu_pattern(spark)
    numbers.write_matrix_market(a, f"file://{tmp_path}/m", 8, 8)
    assert entries(numbers.read_matrix_market(spark, f"file://{tmp_path}/m")) == entries(a)
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 2\n3 1 -1\n3 3 3\n")
    assert entries(numbers.read_matrix_market(spark, f"file://{tmp_path}/s.mtx")) == [(0, 0, 2.0), (0, 2, -1.0), (2, 0, -1.0), (2, 2, 3.0)]
    (tmp_path / "c.mtx").write_text("%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 2 3\n")
    with pytest.raises(ValueError, match="real coordinate"):
        numbers.read_matrix_market(spark, f"file://{tmp_path}/c.mtx")


def test_plain_numbers(spark, tmp_path):
    (tmp_path / "v").write_text("1.5\n-2\n\n3e1\n")
    assert [tuple(r) for r in numbers.read_vector(spark, f"file://{tmp_path}/v").orderBy("i").collect()] == [(0, 1.5), (1, -2.0), (2, 30.0)]
    (tmp_path / "d").write_text("1 2\n3 4\n10\n")
    matrix, total = numbers.read_dense(spark, f"file://{tmp_path}/d", 2)
    assert entries(matrix) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)] and total == 10
    (tmp_path / "q").write_text("2 3\n1 2 3\n4 5 6\n")
    assert entries(numbers.read_sized(spark, f"file://{tmp_path}/q"))[-1] == (1, 2, 6.0)


def test_boeing(spark, tmp_path):
    text = "title                                                                   key\n 3 1 1 1\nrsa            3             3             4             0\n(4I5)           (4I5)           (4E12.4)\n    1    3    4    5\n    1    3    2    3\n  1.0000E+00 -2.5000D+00  3.0000E+00  4.0000E+00\n"
    (tmp_path / "m.rb").write_text(text)
    assert entries(numbers.read_boeing(spark, f"file://{tmp_path}/m.rb")) == [(0, 0, 1.0), (1, 1, 3.0), (2, 0, -2.5), (2, 2, 4.0)]


def test_pixmaps_and_targa(spark, tmp_path):
    rng = np.random.default_rng(9)
    cells = [(x, y, *map(int, rng.integers(0, 256, 3))) for y in range(3) for x in range(4)]
    pixels = spark.createDataFrame(cells, "x long, y long, r long, g long, b long")
    made = rasters.pixmap_files(pixels.withColumn("path", F.lit("p"))).first()
    assert rasters.parse_pixmap(bytes(made.content)).sort_values(["y", "x"])[list("xyrgb")].to_numpy().tolist() == [list(c) for c in cells]
    (tmp_path / "a.ppm").write_bytes(bytes(made.content).replace(b"P6\n", b"P6\n# note\n"))
    assert rasters.read_pixmaps(spark, f"file://{tmp_path}/a.ppm").count() == 12
    rasters.write_ascii_pixmap(pixels, f"file://{tmp_path}/t", 4, 3)
    assert sorted(map(tuple, rasters.read_pixmaps(spark, f"file://{tmp_path}/t/part-*").select(*"xyrgb").collect())) == sorted(cells)
    targa = rasters.encode_targa(pd.DataFrame(cells, columns=list("xyrgb")))
    assert targa[12:16] == bytes([4, 0, 3, 0]) and list(targa[18:21]) == list(cells[0][2:][::-1])


def test_simulation_files(spark, tmp_path):
    (tmp_path / "h").write_text("10 # iterations\n16\n2\n2\n0.0 0.0 1.0 2.5 hot\n0.5 1.0 1.0 2.5\n")
    heat = simulations.read_heat(spark, f"file://{tmp_path}/h")
    assert (heat.iterations, heat.resolution, heat.algorithm, heat.sources.count()) == (10, 16, 2, 2)
    atoms, box = particles._atoms(spark), Box((0.0, 0.0, 0.0), (9.6, 9.6, 9.6), (True, False, True), 2.5)
    simulations.write_dump(atoms, f"file://{tmp_path}/dump", box, 7)
    back, found, step = simulations.read_dump(spark, f"file://{tmp_path}/dump", 2.5)
    assert found == box and step == 7 and sorted(map(tuple, back.collect())) == sorted(map(tuple, atoms.collect()))
    (tmp_path / "r").write_text("Tr=0.5\n" + " ".join(map(str, range(8))) + "\nTr=0.6\n" + " ".join(map(str, range(8))))
    got = simulations.read_stimuli(spark, f"file://{tmp_path}/r", (1, 2, 2)).where("burst = 1").orderBy("ant", "gate").collect()
    assert [(r.ant, r.gate, r.re, r.im) for r in got] == [(0, 0, 0.0, 1.0), (0, 1, 2.0, 3.0), (1, 0, 4.0, 5.0), (1, 1, 6.0, 7.0)]
    point = " ".join(map(str, [*range(9), 3.0, 1.0, 5]))
    (tmp_path / "mesh").write_text("\n".join([point] * 125) + "\n0.5 0.25\n")
    points, nodes = simulations.read_mesh(spark, f"file://{tmp_path}/mesh", 1, 2)
    assert points.count() == 125 and points.first().iglob == 4 and [r.rmass for r in nodes.orderBy("iglob").collect()] == [0.5, 0.25]


def encode_jpeg(blocks, width, height, restart):
    """A file of one grey and two half-sized colour planes of constant blocks, with codes of eight bits for all symbols."""
    table = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))
    bits = ""

    def block(difference):
        nonlocal bits
        size = abs(difference).bit_length()
        value = difference if difference > 0 else difference + (1 << size) - 1
        bits += f"{size:08b}" + (f"{value:0{size}b}" if size else "") + f"{0:08b}"

    parts, before, out = [], [0, 0, 0], b""
    for n, unit in enumerate(blocks):
        for comp, levels in enumerate(unit):
            for level in levels:
                block(level - before[comp])
                before[comp] = level
        if (n + 1) % restart == 0 or n + 1 == len(blocks):
            bits += "1" * (-len(bits) % 8)
            parts.append(int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00"))
            bits, before = "", [0, 0, 0]
    for n, part in enumerate(parts):
        out += part + (bytes([0xFF, 0xD0 + n % 8]) if n + 1 < len(parts) else b"")

    def segment(marker, body):
        return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    frame = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = segment(0xDB, b"\x00" + bytes([8] * 64)) + segment(0xC4, b"\x00" + table) + segment(0xC4, b"\x10" + table)
    head += segment(0xC0, frame) + segment(0xDD, restart.to_bytes(2, "big")) + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    return b"\xff\xd8" + head + out + b"\xff\xd9"


def test_jpeg(spark, tmp_path):
    from gridloom.sources import jpeg

    assert jpeg.ZIGZAG[:6] == [0, 1, 8, 16, 9, 2] and sorted(jpeg.ZIGZAG) == list(range(64))
    units = [([10, -20, 30, 40], [5], [-6]), ([0, 0, 7, -128], [0], [0]), ([1, 2, 3, 4], [-3], [9])]
    (tmp_path / "a.jpg").write_bytes(encode_jpeg(units, 48, 16, 2))
    read = jpeg.read_jpeg(spark, f"file://{tmp_path}/a.jpg")
    assert sorted((r.comp, r.bx, r.by, r.c) for r in read.collect() if r.comp == 0)[:4] == [(0, 0, 0, 10), (0, 0, 1, 30), (0, 1, 0, -20), (0, 1, 1, 40)]
    pixels = {(r.x, r.y): (r.b, r.g, r.r) for r in jpeg.jpeg_pixels(read).collect()}
    assert len(pixels) == 48 * 16
    luma, cb, cr = 128 - 20, 128 + 5 - 128, 128 - 6 - 128
    assert pixels[12, 3] == (round(luma + 1.772 * cb), round(luma - 0.34414 * cb - 0.71414 * cr), round(luma + 1.402 * cr))
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xc2\x00\x04\x00\x00")
    with pytest.raises(ValueError, match="baseline"):
        jpeg.parse_header((tmp_path / "b.jpg").read_bytes())
