"""Pixels of tiled images, of which a query reads the tiles it asks for.

Files: ``path/<case>/<ty>_<tx>.png``, each ``tile`` pixels wide and high but for
the last ones. A partition is one row of tiles of one case. Filters on case_id,
y and x choose the tiles; Spark applies them again to the pixels.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .files import _at

SCHEMA = "case_id string, y int, x int, r int, g int, b int"
TILE = 256


def decode_png(raw: bytes) -> np.ndarray:
    """Rows, columns and RGB of a PNG of 8 bits a channel, grey or RGB, with or without alpha, not interlaced."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body = 8, []
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at:at + 8])
        if kind == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", raw[at + 8:at + 21])
        elif kind == b"IDAT":
            body.append(raw[at + 8:at + 8 + n])
        at += n + 12
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or laced or channels is None:
        raise ValueError("a PNG of another kind")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height + 1, width + 1, channels), np.int64)  # a row above and a column before, of zeros
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:].reshape(width, channels).astype(np.int64)
        up = out[y, 1:]
        if kind == 1:
            line = line.cumsum(0)
        elif kind == 2:
            line = line + up
        elif kind in (3, 4):
            for x in range(width):
                a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                out[y + 1, x + 1] = (line[x] + guess) % 256
            continue
        out[y + 1, 1:] = line % 256
    pixels = out[1:, 1:]
    return pixels[..., :3] if channels >= 3 else np.repeat(pixels[..., :1], 3, axis=2)


@dataclass
class TileRow(InputPartition):
    case: str
    ty: int
    tx: tuple[int, ...]


class TiledImages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiled_images"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TileReader(self.options["path"].rstrip("/"), int(self.options.get("tile", TILE)))


class TileReader(DataSourceReader):
    def __init__(self, path: str, tile: int):
        self.path, self.tile = path, tile
        self.cases: set[str] | None = None
        #: First and last coordinate that is asked for.
        self.span = {"x": [0, None], "y": [0, None]}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "case_id" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.cases = wanted if self.cases is None else self.cases & wanted
            elif name in self.span and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                span = self.span[name]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    span[0] = max(span[0], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    last = f.value - isinstance(f, LessThan)
                    span[1] = last if span[1] is None else min(span[1], last)
            yield f  # the pixels of a tile are filtered by Spark

    def _inside(self, axis: str, at: int) -> bool:
        first, last = self.span[axis]
        return (at + 1) * self.tile > first and (last is None or at * self.tile <= last)

    def partitions(self) -> list[TileRow]:
        from pyarrow.fs import FileSelector, FileType

        fs, base = _at(self.path)
        cases = self.cases
        if cases is None:
            cases = {i.base_name for i in fs.get_file_info(FileSelector(base)) if i.type == FileType.Directory}
        out = []
        for case in sorted(c for c in cases if c and "/" not in c):
            rows: dict[int, list[int]] = {}
            for i in fs.get_file_info(FileSelector(f"{base}/{case}", allow_not_found=True)):
                ty, _, tx = i.base_name.removesuffix(".png").partition("_")
                if i.base_name.endswith(".png") and ty.isdigit() and tx.isdigit() and self._inside("y", int(ty)) and self._inside("x", int(tx)):
                    rows.setdefault(int(ty), []).append(int(tx))
            out += [TileRow(case, ty, tuple(sorted(tx))) for ty, tx in sorted(rows.items())]
        return out or [TileRow("", 0, ())]

    def read(self, part: TileRow):
        fs, base = _at(self.path)
        for tx in part.tx:
            with fs.open_input_stream(f"{base}/{part.case}/{part.ty}_{tx}.png") as f:
                a = decode_png(f.read())
            y, x = np.mgrid[:a.shape[0], :a.shape[1]]
            columns = [(y + part.ty * self.tile).ravel(), (x + tx * self.tile).ravel(), *(a[..., i].ravel() for i in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array([part.case] * a.shape[0] * a.shape[1]), *(pa.array(c, pa.int32()) for c in columns)], ["case_id", "y", "x", "r", "g", "b"])


def read_tiles(spark: SparkSession, path: str, tile: int = TILE) -> DataFrame:
    """(case_id, y, x, r, g, b) of all tiles under ``path``; filters on case_id, y and x choose what is read.

    A case without a folder, and a folder without tiles, have no pixels; other files are passed over.
    """
    spark.dataSource.register(TiledImages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tiled_images").option("path", path).option("tile", tile).load()


def write_tiles(pixels: DataFrame, path: str, tile: int = TILE) -> None:
    """Writes pixels (case_id, y, x, r, g, b) as tiles; a pixel that is missing is black, of repeated ones the last holds.

    A tile is one bounded group, drawn in one task.
    """
    from pyspark.sql import functions as F

    def draw(group):
        import pandas as pd

        from .io import encode_png

        y, x = group["y"] % tile, group["x"] % tile
        a = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3), np.uint8)
        a[y, x] = group[["r", "g", "b"]]
        case, ty, tx = group[["case_id", "ty", "tx"]].iloc[0]
        fs, base = _at(path)
        fs.create_dir(f"{base}/{case}")
        with fs.open_output_stream(f"{base}/{case}/{ty}_{tx}.png") as f:  # a repeated task writes the same
            f.write(encode_png(a.shape[1], a.shape[0], a.tobytes()))
        return pd.DataFrame({"n": [a.shape[0] * a.shape[1]]})

    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    placed = pixels.withColumn("ty", at("y")).withColumn("tx", at("x"))
    placed.groupBy("case_id", "ty", "tx").applyInPandas(draw, "n long").agg(F.sum("n")).collect()
