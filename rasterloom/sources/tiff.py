"""A small TIFF codec: classic and BigTIFF, strips or tiles, pixel or band interleaving, no or DEFLATE
compression, horizontal differencing (predictor 2) on the sample's bytes as integers."""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# TIFF tag numbers and field types.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 270: "description", 273: "offsets", 277: "samples", 278: "rows_per_strip", 279: "sizes", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "offsets", 325: "sizes", 339: "format", 33550: "pixel_scale", 33922: "tie_point", 42112: "metadata", 42113: "nodata"}
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}


@dataclass
class Info:
    """What a raster's header tells."""

    width: int
    height: int
    count: int
    dtype: str
    transform: tuple
    nodata: float | None
    block: tuple[int, int]
    tiled: bool
    planar: bool
    compression: int
    predictor: int
    offsets: tuple
    sizes: tuple
    order: str
    description: str = ""
    metadata: str = ""
    photometric: int = 1
    tags: dict = field(default_factory=dict)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        a, _, c, _, e, f = self.transform
        return c, f + e * self.height, c + a * self.width, f


def read_info(file) -> Info:
    head = file.read(16)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    file.seek(at)
    n = struct.unpack(order + ("Q" if big else "H"), file.read(8 if big else 2))[0]
    width, room = (20, 8) if big else (12, 4)
    entries, tags = file.read(n * width), {}
    for k in range(n):
        tag, kind, count = struct.unpack(order + ("HHQ" if big else "HHI"), entries[k * width : k * width + width - room])
        if tag not in TAGS or kind not in TYPES:
            continue
        size = struct.calcsize(TYPES[kind]) * count
        raw = entries[(k + 1) * width - room : (k + 1) * width]
        if size > room:
            file.seek(struct.unpack(order + ("Q" if big else "I"), raw)[0])
            raw = file.read(size)
        tags[TAGS[tag]] = raw[:size].split(b"\0")[0].decode("latin-1") if kind == 2 else struct.unpack(f"{order}{count}{TYPES[kind]}", raw[:size])
    one = lambda name, default: tags.get(name, (default,))[0]
    bits, kind = one("bits", 8), {1: "u", 2: "i", 3: "f"}[one("format", 1)]
    w, h, tiled = one("width", 0), one("height", 0), "tile_width" in tags
    scale, tie = tags.get("pixel_scale", (1.0, 1.0, 0.0)), tags.get("tie_point", (0.0,) * 6)
    transform = (scale[0], 0.0, tie[3] - tie[0] * scale[0], 0.0, -scale[1], tie[4] + tie[1] * scale[1])
    block = (one("tile_height", 0), one("tile_width", 0)) if tiled else (min(one("rows_per_strip", h), h), w)
    nodata = float(tags["nodata"]) if tags.get("nodata", "").strip() else None
    return Info(w, h, one("samples", 1), f"{kind}{bits // 8}", transform, nodata, block, tiled, one("planar", 1) == 2, one("compression", 1), one("predictor", 1), tags["offsets"], tags["sizes"], order, tags.get("description", ""), tags.get("metadata", ""), one("photometric", 1))


def read_block(file, info: Info, index: int) -> np.ndarray:
    """One strip or tile as (rows, cols, bands in the block)."""
    file.seek(info.offsets[index])
    raw = file.read(info.sizes[index])
    if info.compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif info.compression != 1:
        raise ValueError(f"compression {info.compression} is not supported")
    bands = 1 if info.planar else info.count
    kind = np.dtype(info.order + info.dtype)
    rows = len(raw) // (kind.itemsize * bands * info.block[1])
    data = np.frombuffer(raw, kind, rows * info.block[1] * bands).reshape(rows, info.block[1], bands)
    if info.predictor == 2:
        data = np.cumsum(data.view(np.dtype(f"{info.order}u{kind.itemsize}")), axis=1, dtype=f"u{kind.itemsize}").view(f"{info.dtype}")
    elif info.predictor != 1:
        raise ValueError(f"predictor {info.predictor} is not supported")
    return data.astype(info.dtype)


def read_window(file, info: Info, row: int, col: int, height: int, width: int, bands: list[int] | None = None) -> np.ndarray:
    """(bands, height, width) of a window clipped to the raster; bands count from 1. Only the blocks it meets are read."""
    bands = bands or list(range(1, info.count + 1))
    if any(not 1 <= b <= info.count for b in bands):
        raise IndexError(f"bands must lie in 1..{info.count}")
    r0, c0, r1, c1 = max(row, 0), max(col, 0), min(row + height, info.height), min(col + width, info.width)
    out = np.zeros((len(bands), max(r1 - r0, 0), max(c1 - c0, 0)), info.dtype)
    bh, bw = info.block
    across, down = -(-info.width // bw), -(-info.height // bh)
    for br in range(r0 // bh, -(-r1 // bh) if r1 > r0 else r0 // bh):
        for bc in range(c0 // bw, -(-c1 // bw) if c1 > c0 else c0 // bw):
            planes = {b: b - 1 for b in bands} if info.planar else {0: 0}
            for b, plane in planes.items():
                part = read_block(file, info, plane * across * down + br * across + bc)
                y0, x0 = max(r0, br * bh), max(c0, bc * bw)
                y1, x1 = min(r1, br * bh + part.shape[0]), min(c1, (bc + 1) * bw)
                cut = part[y0 - br * bh : y1 - br * bh, x0 - bc * bw : x1 - bc * bw]
                for k, want in enumerate(bands):
                    if info.planar and want != b:
                        continue
                    out[k, y0 - r0 : y1 - r0, x0 - c0 : x1 - c0] = cut[:, :, 0 if info.planar else want - 1]
    return out


def encode_block(block: np.ndarray, compress: bool = True, level: int = 6) -> bytes:
    """A tile (rows, cols, bands) as it stands in the file."""
    if not compress:
        return np.ascontiguousarray(block).tobytes()
    plain = np.ascontiguousarray(block).view(f"<u{block.dtype.itemsize}")
    steps = plain.copy()
    steps[:, 1:] -= plain[:, :-1]
    return zlib.compress(steps.tobytes(), level)


class Writer:
    """A tiled BigTIFF, pixel interleaved, DEFLATE with predictor 2, written one encoded tile after the other.

    Tiles come by their number in row order, in any order; those that never come hold the nodata value (0 without one). No more than a tile is in memory.
    """

    def __init__(self, path: str, width: int, height: int, bands: int, dtype: str, transform: tuple, nodata: float | None = None, descriptions: list[str] | None = None, tile: tuple[int, int] = (256, 512), compress: bool = True):
        self.width, self.height, self.bands, self.kind = width, height, bands, np.dtype(dtype).newbyteorder("<")
        self.transform, self.nodata, self.descriptions, self.tile, self.compress = transform, nodata, descriptions, tile, compress
        self.across, self.down = -(-width // tile[1]), -(-height // tile[0])
        self.offsets, self.sizes = [0] * (self.across * self.down), [0] * (self.across * self.down)
        self.out = open(path, "wb")
        self.out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))

    def put(self, number: int, encoded: bytes) -> None:
        self.offsets[number], self.sizes[number] = self.out.tell(), len(encoded)
        self.out.write(encoded)

    def reserve(self, tiles: list[tuple[int, int]]) -> dict[int, int]:
        """Room for tiles of known sizes, (number, bytes), one after the other; where each is to be put, by others who open the file too."""
        at, places = self.out.tell(), {}
        for number, size in tiles:
            self.offsets[number], self.sizes[number], places[number] = at, size, at
            at += size
        self.out.seek(at)
        return places

    def __enter__(self):
        return self

    def __exit__(self, kind, *rest):
        if kind is None:
            self._finish()
        self.out.close()

    def _finish(self) -> None:
        if 0 in self.sizes:
            blank = encode_block(np.full((*self.tile, self.bands), 0 if self.nodata is None else self.nodata, self.kind), self.compress)
            at = self.out.tell()
            self.out.write(blank)
            for k, size in enumerate(self.sizes):
                if not size:
                    self.offsets[k], self.sizes[k] = at, len(blank)
        text = ("<GDALMetadata>" + "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{d}</Item>' for k, d in enumerate(self.descriptions)) + "</GDALMetadata>").encode() + b"\0" if self.descriptions else None
        a, _, c, _, e, f = self.transform
        rgb = self.bands == 3
        fields: list[tuple[int, int, tuple | bytes]] = [
            (256, 4, (self.width,)), (257, 4, (self.height,)), (258, 3, (self.kind.itemsize * 8,) * self.bands), (259, 3, (8 if self.compress else 1,)), (262, 3, (2 if rgb else 1,)),
            (277, 3, (self.bands,)), (284, 3, (1,)), (317, 3, (2 if self.compress else 1,)), (322, 3, (self.tile[1],)), (323, 3, (self.tile[0],)),
            (339, 3, ({"u": 1, "i": 2, "f": 3}[self.kind.kind],) * self.bands), (33550, 12, (a, -e, 0.0)), (33922, 12, (0.0, 0.0, 0.0, c, f, 0.0)),
        ]
        if self.bands > 1 and not rgb:
            fields.append((338, 3, (0,) * (self.bands - 1)))
        if text:
            fields.append((42112, 2, text))
        if self.nodata is not None:
            fields.append((42113, 2, repr(float(self.nodata)).encode() + b"\0"))
        fields = sorted([*fields, (324, 16, tuple(self.offsets)), (325, 16, tuple(self.sizes))])
        at = self.out.tell()
        directory, extra, tail = b"", b"", at + 8 + 20 * len(fields) + 8
        for tag, kind, value in fields:
            raw = value if isinstance(value, bytes) else struct.pack(f"<{len(value)}{TYPES[kind]}", *value)
            if len(raw) <= 8:
                directory += struct.pack("<HHQ", tag, kind, len(value)) + raw.ljust(8, b"\0")
            else:
                directory += struct.pack("<HHQQ", tag, kind, len(value), tail + len(extra))
                extra += raw
        self.out.write(struct.pack("<Q", len(fields)) + directory + struct.pack("<Q", 0) + extra)
        self.out.seek(8)
        self.out.write(struct.pack("<Q", at))


def write(path: str, data: np.ndarray, transform: tuple, nodata: float | None = None, descriptions: list[str] | None = None, tile: tuple[int, int] = (256, 512), compress: bool = True) -> None:
    """(bands, height, width) as a file of ``Writer``."""
    bands, h, w = data.shape
    with Writer(path, w, h, bands, data.dtype.str, transform, nodata, descriptions, tile, compress) as out:
        for number, (r, c) in enumerate((r, c) for r in range(0, h, tile[0]) for c in range(0, w, tile[1])):
            block = np.full((*tile, bands), 0 if nodata is None else nodata, out.kind)
            part = data[:, r : r + tile[0], c : c + tile[1]].transpose(1, 2, 0)
            block[: part.shape[0], : part.shape[1]] = part
            out.put(number, encode_block(block, compress))


def recompress(source: str, target: str, level: int = 9) -> tuple[int, int]:
    """The same pixels in DEFLATE tiles, block by block; bytes before and after. Sources of tiles with interleaved pixels."""
    with open(source, "rb") as file:
        info = read_info(file)
        if not info.tiled or info.planar:
            raise ValueError("only tiled rasters with interleaved pixels are compressed in place of their blocks")
        with Writer(target, info.width, info.height, info.count, info.dtype, info.transform, info.nodata, descriptions_of(info), info.block) as out:
            for number in range(len(info.offsets)):
                out.put(number, encode_block(read_block(file, info, number).astype(out.kind), level=level))
    return os.path.getsize(source), os.path.getsize(target)


def descriptions_of(info: Info) -> list[str] | None:
    """Band descriptions of a file, in order."""
    return re.findall(r'role="description">([^<]*)<', info.metadata) or None
