"""Image codecs in plain Python: GeoTIFF (plain, LZW or deflate, strips or tiles) and PNG (8 bit)."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from gridloom.functions.pyramid import Affine

#: TIFF's field types (size, format) and tags that are used here.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT, PIXEL_SCALE, TIEPOINT, GEO_KEYS, METADATA, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42112, 42113
_KIND = {"u": 1, "i": 2, "f": 3}


def write_geotiff(bands: np.ndarray, affine: Affine, crs: str = "EPSG:4326", nodata: float | None = 0, tags: dict[str, str] | None = None) -> bytes:
    """Bytes of a file: bands one after another, a deflated strip each."""
    count, height, width = bands.shape
    bands = np.ascontiguousarray(bands).astype(bands.dtype.newbyteorder("<"))
    strips = [zlib.compress(b.tobytes(), 6) for b in bands]
    fields: dict[int, tuple[int, list]] = _georeferenced(affine, crs, nodata) | {
        WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [bands.dtype.itemsize * 8] * count), COMPRESSION: (3, [8]), PHOTOMETRIC: (3, [1]),
        STRIPS: (4, [0] * count), SAMPLES: (3, [count]), ROWS: (4, [height]), STRIP_BYTES: (4, [len(s) for s in strips]), PLANAR: (3, [2]), SAMPLE_FORMAT: (3, [_KIND[bands.dtype.kind]] * count),
    }
    if tags:
        items = "".join(f'<Item name="{k}">{v}</Item>' for k, v in tags.items())
        fields[METADATA] = (2, [f"<GDALMetadata>{items}</GDALMetadata>\0".encode()])
    head = len(_head(fields, False))
    offsets = [head + sum(len(x) for x in strips[:i]) for i in range(count)]
    return _head({**fields, STRIPS: (4, offsets)}, False) + b"".join(strips)


def _head(fields: dict[int, tuple[int, list]], big: bool) -> bytes:
    """A file's start: its header, its tags, and the values that don't fit into these. ``big``: with 64-bit places."""
    if big:
        count, entry, inline, code, place_at, end = "<Q", "<HHQ", 8, "<Q", 16, b"\0" * 8
        head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16)
    else:
        count, entry, inline, code, place_at, end = "<H", "<HHI", 4, "<I", 8, b"\0" * 4
        head = struct.pack("<2sHI", b"II", 42, 8)
    head += struct.pack(count, len(fields))
    at = place_at + struct.calcsize(count) + (struct.calcsize(entry) + inline) * len(fields) + len(end)
    extra = b""
    for tag in sorted(fields):
        kind, values = fields[tag]
        data = values[0] if kind == 2 else struct.pack(f"<{len(values)}{TYPES[kind][1]}", *values)
        head += struct.pack(entry, tag, kind, len(data) if kind == 2 else len(values))
        if len(data) > inline:
            head += struct.pack(code, at + len(extra))
            extra += data + b"\0" * (len(data) % 2)
        else:
            head += data.ljust(inline, b"\0")
    return head + end + extra


def tiled_start(height: int, width: int, tile: int, bands: int, dtype: np.dtype, affine: Affine, crs: str, nodata: float | None, sizes: list[int], places: list[int]) -> bytes:
    """The start of a file of deflated square tiles, band after band: tile i has ``sizes[i]`` bytes at ``places[i]`` of what follows the start (0 bytes: no data)."""
    dtype = np.dtype(dtype)
    big = sum(sizes) + 40 * len(sizes) + 4096 >= 1 << 32
    wide = 16 if big else 4
    fields = _georeferenced(affine, crs, nodata) | {
        WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [dtype.itemsize * 8] * bands), COMPRESSION: (3, [8]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [bands]), PLANAR: (3, [2]),
        SAMPLE_FORMAT: (3, [_KIND[dtype.kind]] * bands), TILE_WIDTH: (4, [tile]), TILE_HEIGHT: (4, [tile]), TILES: (wide, [0] * len(sizes)), TILE_BYTES: (wide, sizes),
    }
    start = len(_head(fields, big))
    fields[TILES] = (wide, [start + p if n else 0 for p, n in zip(places, sizes)])
    return _head(fields, big)


def _georeferenced(affine: Affine, crs: str, nodata: float | None) -> dict[int, tuple[int, list]]:
    epsg = int(crs.rpartition(":")[2])
    geographic = epsg == 4326
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg]
    out = {PIXEL_SCALE: (12, [affine.a, -affine.e, 0.0]), TIEPOINT: (12, [0.0, 0.0, 0.0, affine.c, affine.f, 0.0]), GEO_KEYS: (3, keys)}
    return out | ({NODATA: (2, [f"{nodata:g}\0".encode()])} if nodata is not None else {})


def geotiff_header(data) -> dict:
    """Tags of the first image, of plain and of 64-bit files; ``data`` is bytes or gives them by slices."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    number = struct.unpack(f"{order}H", data[2:4])[0] if order else 0
    if number not in (42, 43):
        raise ValueError("not a TIFF file")
    big = number == 43
    count, inline, code = ("Q", 8, "Q") if big else ("H", 4, "I")
    at = struct.unpack(f"{order}{code}", data[8:16] if big else data[4:8])[0]
    out: dict = {"order": order}
    wide = struct.calcsize(f"{order}{count}")
    n_tags = struct.unpack(f"{order}{count}", data[at : at + wide])[0]
    at += wide
    head = struct.calcsize(f"{order}HH{code}")
    for i in range(n_tags):
        begin = at + (head + inline) * i
        tag, kind, n = struct.unpack(f"{order}HH{code}", data[begin : begin + head])
        if kind not in TYPES:
            continue
        step, form = TYPES[kind]
        place = begin + head
        if step * n > inline:
            place = struct.unpack(f"{order}{code}", data[place : place + inline])[0]
        raw = data[place : place + step * n]
        if len(raw) < step * n:
            raise IndexError("the tags lie beyond the bytes at hand")
        out[tag] = raw.rstrip(b"\0") if kind == 2 else list(struct.unpack(f"{order}{n * len(form)}{form[0]}", raw))
    return out


@dataclass(frozen=True)
class Layout:
    """How a file's pixels are kept: in blocks (tiles, or strips as wide as the image), of one band each or of all."""

    height: int
    width: int
    count: int
    dtype: str
    packing: int
    predictor: int
    inside: int
    block_height: int
    block_width: int
    tiled: bool
    offsets: list[int]
    sizes: list[int]
    affine: Affine
    crs: str | None
    nodata: float | None

    @classmethod
    def of(cls, h: dict) -> Layout:
        width, height, count = h[WIDTH][0], h[HEIGHT][0], h.get(SAMPLES, [1])[0]
        kind = {1: "u", 2: "i", 3: "f"}[h.get(SAMPLE_FORMAT, [1])[0]]
        packing, predictor = h.get(COMPRESSION, [1])[0], h.get(PREDICTOR, [1])[0]
        if packing not in (1, 5, 8, 32946) or predictor not in (1, 2, 3):
            raise ValueError(f"TIFF compression {packing} with predictor {predictor} isn't supported")
        tiled = TILES in h
        bw, bh = (h[TILE_WIDTH][0], h[TILE_HEIGHT][0]) if tiled else (width, min(height, h.get(ROWS, [height])[0]))
        offsets, sizes = (h[TILES], h[TILE_BYTES]) if tiled else (h[STRIPS], h[STRIP_BYTES])
        inside = 1 if h.get(PLANAR, [1])[0] == 2 else count
        return cls(height, width, count, f"{h['order']}{kind}{h[BITS][0] // 8}", packing, predictor, inside, bh, bw, tiled, offsets, sizes, *_place(h), float(h[NODATA]) if h.get(NODATA) else None)

    def place(self, k: int) -> tuple[int, int, int]:
        """First band, y and x of block k."""
        across, down = -(-self.width // self.block_width), -(-self.height // self.block_height)
        plane, k = divmod(k, across * down)
        return plane, k // across * self.block_height, k % across * self.block_width


def block_pixels(raw: bytes, dtype: str, packing: int, predictor: int, rows: int, width: int, inside: int) -> np.ndarray:
    """Pixels (rows, width, bands inside) of a block's bytes."""
    raw = raw if packing == 1 else _lzw(raw) if packing == 5 else zlib.decompress(raw)
    kind = np.dtype(dtype)
    n = rows * width * inside
    if predictor == 3:
        # Bytes of a row by significance, each the difference from the one before.
        planes = np.cumsum(np.frombuffer(raw, np.uint8)[: n * kind.itemsize].reshape(rows, kind.itemsize, width * inside).reshape(rows, -1, inside), axis=1, dtype=np.uint8)
        planes = planes.reshape(rows, kind.itemsize, width * inside)
        return np.ascontiguousarray(np.moveaxis(planes, 1, 2)).view(kind.newbyteorder(">")).reshape(rows, width, inside)
    block = np.frombuffer(raw, dtype=kind)[:n].reshape(rows, width, inside)
    return np.cumsum(block, axis=1, dtype=kind) if predictor == 2 else block


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the highest bit first, 256 to start anew and 257 to end; widths grow one code early."""
    out, table, before = [], [], b""
    bits = have = 0
    width = 9
    for byte in data:
        bits, have = (bits << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        found = table[code] if code < len(table) else before + before[:1]
        out.append(found)
        if before:
            table.append(before + found[:1])
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        before = found
    return b"".join(out)


def read_geotiff(data: bytes) -> tuple[np.ndarray, dict]:
    """bands (count, height, width) and affine, crs, nodata, dtype."""
    f = Layout.of(geotiff_header(data))
    dtype = np.dtype(f.dtype)
    out = np.full((f.count, f.height, f.width), f.nodata if f.nodata is not None else 0, dtype=dtype)
    for k, (o, n) in enumerate(zip(f.offsets, f.sizes)):
        if not n:
            continue
        plane, y, x = f.place(k)
        rows = f.block_height if f.tiled else min(f.block_height, f.height - y)
        block = block_pixels(data[o : o + n], f.dtype, f.packing, f.predictor, rows, f.block_width, f.inside)
        for b in range(f.inside):
            part = block[: f.height - y, : f.width - x, b]
            out[plane + b, y : y + part.shape[0], x : x + part.shape[1]] = part
    return out, {"affine": f.affine, "crs": f.crs, "nodata": f.nodata, "dtype": dtype.newbyteorder("=").name}


def _place(h: dict) -> tuple[Affine, str | None]:
    sx, sy = h.get(PIXEL_SCALE, [1.0, 1.0])[:2]
    tie = h.get(TIEPOINT, [0.0] * 6)
    keys = h.get(GEO_KEYS, [])
    epsg = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (2048, 3072)), None)
    return Affine(sx, 0.0, tie[3] - tie[0] * sx, 0.0, -sy, tie[4] + tie[1] * sy), f"EPSG:{epsg}" if epsg else None


def geotiff_place(data: bytes) -> tuple[Affine, str | None, int, int]:
    """Affine, projection, height and width, from the header alone."""
    h = geotiff_header(data)
    return *_place(h), h[HEIGHT][0], h[WIDTH][0]


_CHANNELS = {1: 0, 2: 4, 3: 2, 4: 6}


def write_png(bands: np.ndarray) -> bytes:
    """8-bit PNG of 1 to 4 bands (gray, gray and alpha, colour, colour and alpha)."""
    count, height, width = bands.shape
    rows = np.ascontiguousarray(np.moveaxis(bands.astype(np.uint8), 0, 2)).reshape(height, width * count)
    raw = np.concatenate((np.zeros((height, 1), np.uint8), rows), axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, _CHANNELS[count], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """bands of an 8-bit PNG that isn't interlaced."""
    at, packed, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or interlace or colour == 3:
        raise ValueError("only plain 8-bit PNG is supported")
    count = {v: k for k, v in _CHANNELS.items()}[colour]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * count)
    out = np.zeros((height, width * count), np.int32)
    for y in range(height):
        way, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        up = out[y - 1] if y else np.zeros_like(line)
        if way in (0, 2):
            out[y] = (line + (up if way == 2 else 0)) & 255
            continue
        for i in range(len(line)):
            a, c = (out[y, i - count], up[i - count]) if i >= count else (0, 0)
            p = a + up[i] - c
            paeth = min(((abs(p - a), 0, a), (abs(p - up[i]), 1, up[i]), (abs(p - c), 2, c)))[2]
            out[y, i] = (line[i] + {1: a, 3: (a + up[i]) // 2, 4: paeth}[int(way)]) & 255
    return np.moveaxis(out.astype(np.uint8).reshape(height, width, count), 2, 0)
