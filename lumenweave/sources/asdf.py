"""ASDF rasters: a YAML tree with binary blocks, read as the same tile rows as the other raster source.

Needs a YAML parser; without one, ``load`` says so. Uncompressed two-dimensional float and unsigned arrays in
blocks are read, checksums are verified, strides and compression are refused.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenweave.sources import storage
from lumenweave.sources.fits import SCHEMA, chosen, header_batch, tile_batch

MAGIC = b"\xd3BLK"
KINDS = {"float32": "f4", "float64": "f8", "uint32": "u4", "int32": "i4", "uint16": "u2", "int16": "i2", "uint8": "u1"}


def blocks(f) -> list[tuple[int, int, bytes, bytes]]:
    """(place, size, checksum, compression) of each block behind the tree."""
    out = []
    while f.read(4) == MAGIC:
        (n,) = struct.unpack(">H", f.read(2))
        head = f.read(n)
        _, comp, _, used, _ = struct.unpack(">I4sQQQ", head[:32])
        allocated = struct.unpack(">Q", head[8:16])[0]
        out.append((f.tell(), used, head[32:48], comp))
        f.seek(allocated, os.SEEK_CUR)
    return out


def tree_and_blocks(path: str) -> tuple[dict, list]:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading this format needs a YAML parser") from e

    class Loader(yaml.SafeLoader):
        pass

    def plain(loader, suffix, node):
        if isinstance(node, yaml.MappingNode):
            return loader.construct_mapping(node, deep=True)
        if isinstance(node, yaml.SequenceNode):
            return loader.construct_sequence(node, deep=True)
        return loader.construct_scalar(node)

    Loader.add_multi_constructor("!", plain)
    Loader.add_multi_constructor("tag:", plain)
    with storage.reading(path) as f:
        head, end = b"", -1
        while end < 0:  # the tree ends in a line of three dots
            more = f.read(1 << 16)
            head += more
            end = head.find(b"\n...")
            if not more and end < 0:
                end = len(head)
        if not head.startswith(b"#ASDF"):
            raise ValueError(f"{path} isn't of this format")
        text = [line for line in head[: end + 1].splitlines(keepends=True) if not line.startswith((b"#", b"%"))]
        behind = head.find(b"\n", end + 1)
        f.seek(behind + 1 if behind >= 0 else len(head))
        return yaml.load(b"".join(text).replace(b"--- !", b"!", 1), Loader), blocks(f)


def arrays(tree, path: tuple[str, ...] = ()) -> Iterator[tuple[str, dict]]:
    if isinstance(tree, dict):
        if {"source", "datatype", "shape"} <= set(tree):
            yield ".".join(path), tree
            return
        for k, v in tree.items():
            yield from arrays(v, (*path, str(k)))


def cards(tree, path: tuple[str, ...] = ()) -> dict[str, str]:
    """Scalars of the tree by dotted path, as text."""
    out: dict[str, str] = {}
    for k, v in (tree or {}).items():
        if isinstance(v, dict):
            if "source" not in v:
                out |= cards(v, (*path, str(k)))
        elif isinstance(v, (str, int, float, bool)):
            out[".".join((*path, str(k)))] = str(v)
    return out


def read_array(path: str, node: dict, places: list) -> np.ndarray:
    at, size, checksum, comp = places[node["source"]]
    if comp != b"\0\0\0\0" or "strides" in node:
        raise ValueError(f"{path}: compressed or strided arrays are not read")
    with storage.reading(path) as f:
        f.seek(at)
        raw = f.read(size)
    if checksum != b"\0" * 16 and hashlib.md5(raw).digest() != checksum:
        raise ValueError(f"{path}: block {node['source']} is damaged")
    kind = (">" if node.get("byteorder", "little") == "big" else "<") + KINDS[node["datatype"]]
    return np.frombuffer(raw, dtype=kind, offset=node.get("offset", 0), count=int(np.prod(node["shape"]))).reshape(node["shape"])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class AsdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tile = options["path"], int(options.get("tilesize", options.get("tileSize", "256")))
        self.pixels = options.get("pixels", "true").lower() == "true"
        self.wanted = chosen(options)

    def partitions(self):
        return [_File(n) for n, _ in storage.children(self.path) if n.lower().endswith(".asdf")]

    def read(self, partition):
        tree, places = tree_and_blocks(partition.path)
        head_cards, step = cards(tree), self.tile
        for k, (name, node) in enumerate(arrays(tree)):
            if len(node["shape"]) != 2 or any(self.wanted[c] is not None and v not in self.wanted[c] for c, v in (("hdu", k), ("extname", name))):
                continue
            height, width = node["shape"]
            head = (partition.path, k, name, None, head_cards, width, height)
            if not self.pixels:
                yield header_batch(head)
                continue
            a = read_array(partition.path, node, places)
            exact = np.issubdtype(a.dtype, np.integer)
            for y0 in range(0, height, step):
                strip = a[y0 : y0 + step]
                cut = [(x0, y0, strip[:, x0 : x0 + step]) for x0 in range(0, width, step)]
                yield tile_batch(head, [(x0, y, t.astype(np.float32), t.astype(np.int64) if exact else None) for x0, y, t in cut], step)


class AsdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "asdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return AsdfReader(dict(self.options))


def register(spark) -> None:
    from lumenweave.session import ship_package

    ship_package(spark)
    spark.dataSource.register(AsdfSource)


def write_asdf(path: str, planes: dict[str, np.ndarray], cards_: dict[str, str]) -> None:
    """A small file of this format (for round trips): scalars by dotted path, arrays as blocks."""
    lines, body = ["#ASDF 1.0.0", "#ASDF_STANDARD 1.5.0", "%YAML 1.1", "--- !core/asdf-1.1.0"], b""
    lines += [f"{k}: {v!r}" for k, v in cards_.items()]
    names = {v: k for k, v in KINDS.items()}
    for k, (name, a) in enumerate(planes.items()):
        kind = names[a.dtype.str[1:]]
        lines += [f"{name}: !core/ndarray-1.0.0", f"  source: {k}", f"  datatype: {kind}", "  byteorder: little", f"  shape: [{a.shape[0]}, {a.shape[1]}]"]
        raw = a.astype(a.dtype.newbyteorder("<")).tobytes()
        body += MAGIC + struct.pack(">H", 48) + struct.pack(">I4sQQQ", 0, b"\0\0\0\0", len(raw), len(raw), len(raw)) + hashlib.md5(raw).digest() + raw
    with storage.writing(path) as f:
        f.write("\n".join([*lines, "...", ""]).encode() + body)


def open_raster(spark, path: str, **options: str):
    """Tile rows of a file or folder of either format, told by magic bytes or suffix."""
    from lumenweave.sources import fits

    first = next((n for n, _ in storage.children(path) if n.lower().endswith((*fits.SUFFIXES, ".asdf"))), "")
    magic = b""
    if first:
        with storage.reading(first) as f:
            magic = f.read(9)
    kind = "asdf" if magic.startswith(b"#ASDF") or (not magic and path.lower().endswith(".asdf")) else "fits"
    (register if kind == "asdf" else fits.register)(spark)
    reader = spark.read.format(kind)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)
