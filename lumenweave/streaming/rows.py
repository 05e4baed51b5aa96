"""A stream of image rows out of a landing folder of FITS files.

``spark.readStream.format("fits_rows").load(folder)`` gives a row per raster row: file, hdu, extname, y, data, exact. An offset is (file, strip): strips of the files
before that one, and that file's first ``strip`` ones, have been read. Files are taken by path, so they must land under rising names, whole (written aside and
renamed). A micro-batch takes strips until it has ``rowsPerBatch`` rows; each strip of ``stripRows`` rows is a partition, so that is what a task holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lumenweave.sources import storage
from lumenweave.sources.fits import SUFFIXES, card_number, decode, list_arrays, planes

SCHEMA = "file string, hdu int, extname string, y int, data array<float>, exact array<bigint>"


class Strip(InputPartition):
    def __init__(self, path: str, hdu: int, y0: int, rows: int):
        self.path, self.hdu, self.y0, self.rows = path, hdu, y0, rows


class RowStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("rowsperbatch", options.get("rowsPerBatch", "4096")))
        self.step = int(options.get("striprows", options.get("stripRows", "256")))
        self.at: dict | None = None  # the end of what has been planned
        self.known: dict[str, list[Strip]] = {}

    def files(self) -> list[str]:
        return [n for n, _ in storage.children(self.path) if n.lower().endswith(SUFFIXES)]

    def strips(self, path: str) -> list[Strip]:
        """The strips of a file's images, from its headers alone."""
        if path not in self.known:
            images = [(k, dims[1]) for k, cards, dims, _ in planes(path) if len(dims) == 2 and cards.get("XTENSION", "IMAGE") in ("IMAGE", "")]
            self.known[path] = [Strip(path, k, y, min(self.step, height - y)) for k, height in images for y in range(0, height, self.step)]
        return self.known[path]

    def initialOffset(self) -> dict:
        return {"file": "", "strip": 0}

    def latestOffset(self) -> dict:
        at = self.at or self.initialOffset()
        rows = 0
        for path in self.files():
            if path < at["file"]:
                continue
            strips = self.strips(path)
            first = at["strip"] if path == at["file"] else 0
            for k in range(first, len(strips)):
                if rows >= self.most:
                    break
                rows += strips[k].rows
                at = {"file": path, "strip": k + 1}
            if rows >= self.most:
                break
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Strip]:
        # a restarted query plans the last batch of its log again before it asks for more
        self.at = self.at or end
        out = []
        for path in self.files():
            if start["file"] <= path <= end["file"]:
                strips = self.strips(path)
                out += strips[start["strip"] if path == start["file"] else 0 : end["strip"] if path == end["file"] else len(strips)]
        return out

    def read(self, partition: Strip):
        for k, cards, dims, at in planes(partition.path):
            if k != partition.hdu:
                continue
            width, size = dims[0], abs(int(card_number(cards["BITPIX"]))) // 8
            with storage.reading(partition.path) as f:
                f.seek(at + partition.y0 * width * size)
                v, bits = decode(f.read(partition.rows * width * size), cards, True)
            n = partition.rows
            rows = lambda a: list(np.asarray(a).reshape(n, width))
            yield pa.RecordBatch.from_arrays([
                pa.array([partition.path] * n), pa.array([k] * n, pa.int32()), pa.array([cards.get("EXTNAME", "")] * n),
                pa.array(range(partition.y0, partition.y0 + n), pa.int32()), list_arrays(rows(v), pa.float32()),
                pa.nulls(n, pa.list_(pa.int64())) if bits is None else list_arrays(rows(bits), pa.int64()),
            ], names=[c.split()[0] for c in SCHEMA.split(", ")])

    def commit(self, end: dict) -> None:
        for path in [p for p in self.known if p < end["file"]]:
            del self.known[path]


class RowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits_rows"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RowStream(dict(self.options))


def register(spark) -> None:
    from lumenweave.session import ship_package

    ship_package(spark)
    spark.dataSource.register(RowSource)
