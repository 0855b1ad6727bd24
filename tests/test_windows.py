"""Windows of large GeoTIFFs: the bytes that are read, all layouts against whole files, and blocks for tiles."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.bounds import Bounds
from gridloom.functions.pyramid import GEODETIC, Affine, Pyramid
from gridloom.sources import images, readers, windows


def lzw(data: bytes) -> bytes:
    """TIFF's LZW by the plain greedy way."""
    codes, table, width, held = [(256, 9)], {bytes([i]): i for i in range(256)}, 9, b""
    size = 258
    for byte in data:
        grown = held + bytes([byte])
        if grown in table:
            held = grown
            continue
        codes.append((table[held], width))
        table[grown], size = size, size + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            codes.append((256, width))
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        held = bytes([byte])
    codes.append((table[held], width))
    size += 1
    width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def tiff(bands: np.ndarray, tile: int, packing: int, predictor: int, planar: int, tail: bool = False) -> bytes:
    """A tiled file; with ``tail`` its tags come after the pixels."""
    n, height, width = bands.shape
    groups = [bands[i : i + 1] for i in range(n)] if planar == 2 else [bands]
    blocks = []
    for g in groups:
        for y in range(0, height, tile):
            for x in range(0, width, tile):
                block = np.zeros((tile, tile, len(g)), bands.dtype)
                part = np.moveaxis(g[:, y : y + tile, x : x + tile], 0, 2)
                block[: part.shape[0], : part.shape[1]] = part
                if predictor == 2:
                    block[:, 1:] = block[:, 1:] - block[:, :-1]
                    raw = block.tobytes()
                elif predictor == 3:
                    planes = np.moveaxis(block.astype(bands.dtype.newbyteorder(">")).reshape(tile, -1).view(np.uint8).reshape(tile, -1, bands.dtype.itemsize), 2, 1).reshape(tile, -1, len(g))
                    planes = planes.copy()
                    planes[:, 1:] = planes[:, 1:] - planes[:, :-1]
                    raw = planes.tobytes()
                else:
                    raw = block.tobytes()
                blocks.append(raw if packing == 1 else lzw(raw) if packing == 5 else zlib.compress(raw))
    fields = images._georeferenced(Affine(1.0, 0.0, -10.0, 0.0, -1.0, 20.0), "EPSG:4326", -1) | {
        images.WIDTH: (4, [width]), images.HEIGHT: (4, [height]), images.BITS: (3, [bands.dtype.itemsize * 8] * n), images.COMPRESSION: (3, [packing]), images.PHOTOMETRIC: (3, [1]), images.SAMPLES: (3, [n]),
        images.PLANAR: (3, [planar]), images.PREDICTOR: (3, [predictor]), images.SAMPLE_FORMAT: (3, [images._KIND[bands.dtype.kind]] * n), images.TILE_WIDTH: (4, [tile]), images.TILE_HEIGHT: (4, [tile]),
        images.TILES: (4, [0] * len(blocks)), images.TILE_BYTES: (4, [len(b) for b in blocks]),
    }
    start = 8 if tail else len(images._head(fields, False))
    fields[images.TILES] = (4, [start + sum(map(len, blocks[:i])) for i in range(len(blocks))])
    if not tail:
        return images._head(fields, False) + b"".join(blocks)
    body = b"".join(blocks)
    body += b"\0" * (len(body) % 2)
    at, head = 8 + len(body), images._head(fields, False)
    # Places inside the tags move with them.
    out, entries = bytearray(head[8:]), struct.unpack("<H", head[8:10])[0]
    for i in range(entries):
        tag, kind, count = struct.unpack_from("<HHI", out, 2 + 12 * i)
        if images.TYPES[kind][0] * count > 4:
            struct.pack_into("<I", out, 2 + 12 * i + 8, struct.unpack_from("<I", out, 2 + 12 * i + 8)[0] - 8 + at)
    return struct.pack("<2sHI", b"II", 42, at) + body + bytes(out)


@pytest.mark.parametrize("packing, predictor, planar, dtype", [(1, 1, 1, "uint8"), (5, 1, 2, "int16"), (5, 2, 1, "uint16"), (8, 2, 2, "int32"), (8, 3, 1, "float32"), (5, 3, 2, "float64")])
def test_layouts(packing, predictor, planar, dtype):
    rng = np.random.default_rng(5)
    bands = (rng.random((2, 37, 53)) * 100).astype(dtype)
    bands[:, 5:20] = bands[:, 4:5]
    for tail in (False, True):
        data = tiff(bands, 16, packing, predictor, planar, tail)
        assert np.array_equal(images.read_geotiff(data)[0], bands)
        rows = windows.index_rows("x", lambda at, n: data[at : at + n])
        table = [dict(zip(rows, v)) for v in zip(*rows.values())]
        out = np.full(bands.shape, np.nan)
        for c in windows.decoded_blocks(table, lambda path: lambda at, n: data[at : at + n]):
            for band, box, h, w, pixels in zip(c["band"], c["box"], c["height"], c["width"], c["pixels"].to_pylist()):
                y, x = round(20 - box["top"]), round(box["left"] + 10)
                out[band - 1, y : y + h, x : x + w] = np.array(pixels, dtype=float).reshape(h, w)
        assert np.array_equal(out, bands.astype(float))


def test_a_window_reads_few_bytes():
    bands = np.random.default_rng(1).integers(0, 255, (1, 2048, 2048)).astype(np.uint8)
    data = tiff(bands, 64, 8, 1, 2, tail=True)
    read = []

    def at(place, n):
        read.append(len(data[place : place + n]))
        return data[place : place + n]

    rows = windows.index_rows("x", at)
    assert len(rows["path"]) == 32 * 32 and sum(read) <= 3 * windows.PAGE
    wanted = [r for r in (dict(zip(rows, v)) for v in zip(*rows.values())) if r["box"]["left"] < 90 and r["box"]["right"] > 0 and r["box"]["top"] > -100 and r["box"]["bottom"] < 0]
    found = list(windows.decoded_blocks(wanted, lambda path: at))
    assert len(found) == len(wanted) == 4 and sum(read) < 0.06 * len(data)


def test_blocks_for_tiles(spark, tmp_path):
    bands = np.arange(64 * 64).reshape(1, 64, 64).astype(np.int32)
    (tmp_path / "a.tif").write_bytes(tiff(bands, 16, 5, 2, 1))
    index = windows.block_index(spark, str(tmp_path / "a.tif"))
    assert index.count() == 16 and windows.within(index, Bounds(0.0, 0.0, 5.0, 5.0)).count() == 2
    pyramid = Pyramid(GEODETIC, tile_size=8)
    tiles = spark.createDataFrame([(4, 7, 15)], "zoom int, row int, col int")
    some = windows.for_tiles(index, tiles, pyramid, 4)
    assert 0 < some.count() < 16
    whole = readers.raster_to_tiles(readers.raster_files(spark, str(tmp_path / "a.tif")), pyramid, 4).where("row = 7 AND col = 15 AND value IS NOT NULL")
    part = readers.raster_to_tiles(windows.read_blocks(some), pyramid, 4).where("row = 7 AND col = 15 AND value IS NOT NULL")
    key = lambda df: sorted(map(tuple, df.select("py", "px", F.col("value")).collect()))
    assert key(part) == key(whole) and key(part)
