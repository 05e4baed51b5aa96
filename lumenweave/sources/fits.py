"""FITS files as a Spark data source, and a writer for them.

``spark.read.format("fits").load(folder)`` gives a row per tile of each image plane: file, hdu, name, version, cards,
width, height, the tile's place and its samples. Header-only reads (``option("pixels", "false")``) decode nothing;
the options ``hdu``, ``extname`` and ``extver`` (lists with commas) choose planes, and the reader seeks past others. (Filters aren't
pushed: Spark keeps what it pushed to a Python source for all scans of one frame.) Large files are read by several tasks, each of
which takes its share of the strips. Integer planes are scaled by BSCALE and BZERO with BLANK
as NaN; masks keep their exact bits in ``exact``. ``spark.read.format("fits_table").option("extname", ...)`` reads a binary table.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lumenweave.sources import storage

BLOCK, CARD = 2880, 80
TABLE_SHARE = 64 << 20  # bytes of a file: a task's share of its table's rows
SUFFIXES = (".fits", ".fit", ".fts")
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
SCHEMA = (
    "file string, hdu int, extname string, extver int, cards map<string,string>, width int, height int, "
    "tx int, ty int, x0 int, y0 int, tile_width int, tile_height int, data array<float>, exact array<bigint>"
)


def card_value(raw: str) -> str:
    """The value of a card's text after '= ': a quoted string with doubled quotes undone, or what stands before the comment."""
    raw = raw.strip()
    if raw.startswith("'"):
        m = re.match(r"'((?:[^']|'')*)'?", raw)
        return m[1].replace("''", "'").rstrip()
    return raw.split("/", 1)[0].strip()


def card_number(text: str | None) -> float | None:
    """A number, with Fortran's D exponent and what follows a slash cut; None where it isn't one."""
    try:
        return float((text or "").split("/", 1)[0].strip().replace("D", "E").replace("d", "e"))
    except ValueError:
        return None


def read_header(f) -> dict[str, str] | None:
    """Cards through END; None at the end of the file. The file stands behind the header's last block then."""
    cards: dict[str, str] = {}
    while True:
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            return None
        for k in range(0, BLOCK, CARD):
            line = block[k : k + CARD].decode("latin-1")
            key = line[:8].strip()
            if key == "END":
                return cards
            if line[8:10] == "= ":
                cards.setdefault(key, card_value(line[10:]))
            elif key in ("COMMENT", "HISTORY"):
                cards[key] = "\n".join(x for x in (cards.get(key), line[8:].rstrip()) if x)


def shape(cards: dict[str, str]) -> tuple[list[int], int]:
    """Axis lengths and bytes of the data behind a header."""
    naxis = int(card_number(cards.get("NAXIS")) or 0)
    dims = [int(card_number(cards.get(f"NAXIS{k}")) or 0) for k in range(1, naxis + 1)]
    if any(d < 0 for d in dims) or math.prod(dims) > 1 << 40:
        raise ValueError(f"impossible axes {dims}")
    bits = abs(int(card_number(cards.get("BITPIX")) or 8))
    groups = int(card_number(cards.get("GCOUNT")) or 1)
    extra = int(card_number(cards.get("PCOUNT")) or 0)
    return dims, bits // 8 * groups * (extra + math.prod(dims)) if dims else 0


def planes(path: str) -> Iterator[tuple[int, dict[str, str], list[int], int]]:
    """(number, cards, axes, place of the data) of each header unit; a truncated tail ends the file after the whole ones."""
    with storage.reading(path) as f:
        size, k = f.size(), 0
        while (cards := read_header(f)) is not None:
            dims, n = shape(cards)
            at = f.tell()
            if at + n > size:
                return
            yield k, cards, dims, at
            f.seek(at + -(-n // BLOCK) * BLOCK)
            k += 1


def decode(raw: bytes, cards: dict[str, str], exact: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Samples as float32, and, for integers, their exact values (unsigned where BZERO says so)."""
    bits = int(card_number(cards.get("BITPIX")) or 8)
    a = np.frombuffer(raw, dtype=KINDS[bits])
    if bits < 0:
        return a.astype(np.float32), None
    scale, zero = card_number(cards.get("BSCALE")), card_number(cards.get("BZERO"))
    scale, zero = 1.0 if scale is None else scale, zero or 0.0
    v = a.astype(np.float64) * scale + zero
    blank = card_number(cards.get("BLANK"))
    if blank is not None:
        v[a == blank] = np.nan
    return v.astype(np.float32), (a.astype(np.int64) + int(zero) if exact and scale == 1 else None)


class _Part(InputPartition):
    """The ``part``-th of ``parts`` shares of a file's strips."""

    def __init__(self, path: str, part: int, parts: int):
        self.path, self.part, self.parts = path, part, parts


def chosen(options: dict) -> dict[str, set | None]:
    """Which hdu, extname and extver are asked for; None where any is."""
    given = {c: options.get(c) for c in ("hdu", "extname", "extver")}
    return {c: None if v is None else {x if c == "extname" else int(x) for x in v.split(",")} for c, v in given.items()}


def list_arrays(tiles: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays as a list column, without a Python value a sample."""
    ends = np.cumsum([0, *(t.size for t in tiles)]).astype(np.int32)
    flat = np.concatenate([t.ravel() for t in tiles]) if tiles else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))


def tile_batch(head: tuple, tiles: list[tuple[int, int, np.ndarray, np.ndarray | None]], step: int) -> pa.RecordBatch:
    """A row a tile (x0, y0, samples, exact bits) of the plane that ``head`` tells of: file, hdu, extname, extver, cards, width, height."""
    n = len(tiles)
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.int32())
    cols = [pa.array([list(x.items()) if isinstance(x, dict) else x] * n, k) for x, k in zip(head, kinds)]
    number = lambda values: pa.array(values, pa.int32())
    cols += [number([x0 // step for x0, *_ in tiles]), number([y0 // step for _, y0, *_ in tiles]), number([t[0] for t in tiles]), number([t[1] for t in tiles])]
    cols += [number([t[2].shape[1] for t in tiles]), number([t[2].shape[0] for t in tiles]), list_arrays([t[2] for t in tiles], pa.float32())]
    cols.append(list_arrays([t[3] for t in tiles], pa.int64()) if all(t[3] is not None for t in tiles) else pa.nulls(n, pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.replace("map<string,string>", "map").split(", ")])


def header_batch(head: tuple) -> pa.RecordBatch:
    """The row of a unit without pixels."""
    empty = tile_batch(head, [(0, 0, np.zeros((1, 1), dtype=np.float32), None)], 1)
    return pa.RecordBatch.from_arrays([*empty.columns[:7], *(pa.nulls(1, c.type) for c in empty.columns[7:])], names=empty.schema.names)


class FitsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tile = options["path"], int(options.get("tilesize", options.get("tileSize", "256")))
        self.split = int(options.get("splitbytes", options.get("splitBytes", str(128 << 20))))
        self.pixels = options.get("pixels", "true").lower() == "true"
        self.exact = options.get("exact", "true").lower() == "true"
        self.wanted = chosen(options)

    def partitions(self):
        """Direct children with a known suffix, by path, star maps left out; a part for each ``splitBytes``. Nothing is opened."""
        found = storage.children(self.path)
        good = [(n, size) for n, size in found if n.lower().endswith(SUFFIXES) and not n.lower().endswith("_starmap.fits")]
        parts = lambda size: max(1, -(-size // self.split)) if self.pixels else 1
        return [_Part(n, k, parts(size)) for n, size in good for k in range(parts(size))]

    def read(self, partition: _Part):
        strip, step = 0, self.tile
        for k, cards, dims, at in planes(partition.path):
            name, version = cards.get("EXTNAME", ""), card_number(cards.get("EXTVER"))
            version = None if version is None else int(version)
            if any(self.wanted[c] is not None and v not in self.wanted[c] for c, v in (("hdu", k), ("extname", name), ("extver", version))):
                continue
            width, height = (dims[0], dims[1]) if len(dims) >= 2 else (0, 0)
            head = (partition.path, k, name, version, cards, width, height)
            if not self.pixels or not width or cards.get("XTENSION", "IMAGE") not in ("IMAGE", ""):
                if partition.part == 0:
                    yield header_batch(head)
                continue
            size = abs(int(card_number(cards["BITPIX"]))) // 8
            with storage.reading(partition.path) as f:
                for y0 in range(0, height, step):  # a strip of tiles at a time
                    strip += 1
                    if strip % partition.parts != partition.part:
                        continue
                    rows = min(step, height - y0)
                    f.seek(at + y0 * width * size)
                    v, bits = decode(f.read(rows * width * size), cards, self.exact)
                    v = v.reshape(rows, width)
                    bits = None if bits is None else bits.reshape(rows, width)
                    yield tile_batch(head, [(x0, y0, v[:, x0 : x0 + step], None if bits is None else bits[:, x0 : x0 + step]) for x0 in range(0, width, step)], step)


class FitsSource(DataSource):
    """``register(spark)``, then ``spark.read.format("fits").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FitsReader(dict(self.options))


#: Letters of a table's forms: numpy kind, Spark type. Fixed values of the format.
FORMS = {"L": ("S1", "boolean"), "B": ("u1", "int"), "I": (">i2", "int"), "J": (">i4", "int"), "K": (">i8", "long"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string")}


def table_layout(cards: dict[str, str]) -> list[tuple[str, str, str]]:
    """(name, numpy kind, Spark type) of a binary table's columns; a column of several numbers is refused."""
    out = []
    for k in range(1, int(card_number(cards.get("TFIELDS")) or 0) + 1):
        m = re.match(r"(\d*)([A-Z])", cards[f"TFORM{k}"])
        n, letter = int(m[1] or 1), m[2]
        if letter not in FORMS or (n != 1 and letter != "A"):
            raise ValueError(f"form {cards[f'TFORM{k}']!r} is not read")
        kind, spark_type = FORMS[letter]
        out.append((cards.get(f"TTYPE{k}", f"COL{k}").strip(), f"S{n}" if letter == "A" else kind, spark_type))
    return out


class TableReader(DataSourceReader):
    def __init__(self, options: dict, layout):
        self.path, self.name, self.layout = options["path"], options.get("extname", ""), layout

    def partitions(self):
        shares = lambda size: max(1, -(-size // TABLE_SHARE))
        return [_Part(n, k, shares(size)) for n, size in storage.children(self.path) if n.lower().endswith(SUFFIXES) for k in range(shares(size))]

    def read(self, partition: _Part):
        dtype = np.dtype([(n, k) for n, k, _ in self.layout])
        for _, cards, dims, at in planes(partition.path):
            if cards.get("XTENSION") != "BINTABLE" or cards.get("EXTNAME", "") != self.name:
                continue
            if [x[:2] for x in table_layout(cards)] != [x[:2] for x in self.layout] or dims[0] != dtype.itemsize:
                raise ValueError(f"{partition.path}: another layout of {self.name}")
            with storage.reading(partition.path) as f:
                # a task's share of the rows
                first, end = (dims[1] * k // partition.parts for k in (partition.part, partition.part + 1))
                for row in range(first, end, 8192):
                    n = min(8192, end - row)
                    f.seek(at + row * dtype.itemsize)
                    got = np.frombuffer(f.read(n * dtype.itemsize), dtype=dtype)
                    cols = [pa.array([partition.path] * n, pa.string())]
                    for name, kind, spark_type in self.layout:
                        c = got[name]
                        if spark_type == "boolean":
                            cols.append(pa.array(c == b"T"))
                        elif kind.startswith("S"):
                            cols.append(pa.array([x.decode("latin-1").rstrip(" \0") for x in c], pa.string()))
                        else:
                            width = {"int": "i4", "long": "i8", "float": "f4", "double": "f8"}[spark_type]
                            cols.append(pa.array(c.astype(width)))
                    yield pa.RecordBatch.from_arrays(cols, names=["file", *(n.lower() for n, _, _ in self.layout)])


class TableSource(DataSource):
    """A binary table of a file, or of a folder's files where they have one layout; columns have small names, ``file`` comes first."""

    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def _layout(self):
        options = dict(self.options)
        for path, _ in storage.children(options["path"]):
            if path.lower().endswith(SUFFIXES):
                for _, cards, _, _ in planes(path):
                    if cards.get("XTENSION") == "BINTABLE" and cards.get("EXTNAME", "") == options.get("extname", ""):
                        return table_layout(cards)
        raise ValueError(f"{options['path']}: no table {options.get('extname', '')!r}")

    def schema(self) -> str:
        return ", ".join(["file string", *(f"`{n.lower()}` {t}" for n, _, t in self._layout())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return TableReader(dict(self.options), self._layout())


def register(spark) -> None:
    """Make the formats known to a session."""
    from lumenweave.session import ship_package

    ship_package(spark)
    spark.dataSource.register(FitsSource)
    spark.dataSource.register(TableSource)


def pixels(tiles):
    """Long view of tile rows: file, hdu, x, y, v and exact."""
    from pyspark.sql import functions as F

    each = tiles.filter("data IS NOT NULL").select("file", "hdu", "extname", "extver", "x0", "y0", "tile_width", "exact", F.posexplode("data").alias("k", "v"))
    return each.select(
        "file", "hdu", "extname", "extver", (F.col("x0") + F.col("k") % F.col("tile_width")).alias("x"),
        (F.col("y0") + F.floor(F.col("k") / F.col("tile_width"))).cast("int").alias("y"), "v", F.element_at("exact", F.col("k") + 1).alias("exact"),
    )


# --- writing --------------------------------------------------------------------------------------

RESERVED = {"SIMPLE", "XTENSION", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "EXTEND", "PCOUNT", "GCOUNT", "BSCALE", "BZERO", "BLANK", "END", "EXTNAME", "EXTVER"}


def card(key: str, value) -> bytes:
    if not re.fullmatch(r"[A-Z0-9_-]{1,8}", key):
        raise ValueError(f"{key!r} is no keyword")
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, float)):
        text = f"{value!r:>20}".replace("e", "E")
    else:
        quoted = str(value).replace("'", "''")
        text = f"'{quoted:<8}'"
    line = f"{key:<8}= {text}"
    if len(line) > CARD:
        raise ValueError(f"{key} is too long")
    return line.ljust(CARD).encode("ascii", "replace")


def encode_plane(data: np.ndarray, cards: dict, first: bool, name: str = "", version: int | None = None) -> bytes:
    """Header and data of a plane; float32, or int32 for exact masks. Scaling cards of a source are dropped."""
    kind, bits = (">i4", 32) if np.issubdtype(data.dtype, np.integer) else (">f4", -32)
    head = [card("SIMPLE", True) if first else card("XTENSION", "IMAGE"), card("BITPIX", bits), card("NAXIS", 2), card("NAXIS1", data.shape[1]), card("NAXIS2", data.shape[0])]
    head += [card("EXTEND", True)] if first else [card("PCOUNT", 0), card("GCOUNT", 1)]
    if name:
        head.append(card("EXTNAME", name))
    if version is not None:
        head.append(card("EXTVER", version))
    for k, v in cards.items():
        if isinstance(v, bool):
            head.append(card(k, v))
        elif k not in RESERVED and re.fullmatch(r"[A-Z0-9_-]{1,8}", k):
            number = v if not isinstance(v, str) else (card_number(v) if re.fullmatch(r"[-+.0-9EeDd]+", v) else None)
            head.append(card(k, v if number is None else (int(number) if float(number).is_integer() and "." not in str(v) else number)))
    text = b"".join(head) + b"END".ljust(CARD)
    body = data.astype(kind).tobytes()
    return text.ljust(-(-len(text) // BLOCK) * BLOCK) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def table_header(name: str, columns: list[tuple[str, str]], size: int, rows: int, cards: dict | None = None) -> bytes:
    """Header of a binary table of so many rows of ``size`` bytes."""
    head = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", size), card("NAXIS2", rows)]
    head += [card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(columns)), card("EXTNAME", name)]
    for k, (column, form) in enumerate(columns, 1):
        head += [card(f"TTYPE{k}", column), card(f"TFORM{k}", form)]
    head += [card(k, v) for k, v in (cards or {}).items()]
    text = b"".join(head) + b"END".ljust(CARD)
    return text.ljust(-(-len(text) // BLOCK) * BLOCK)


def encode_table(name: str, columns: list[tuple[str, str]], rows: np.ndarray, cards: dict | None = None) -> bytes:
    """Header and data of a binary table; ``columns`` are (name, form), ``rows`` a structured array in their order."""
    body = rows.tobytes()
    return table_header(name, columns, rows.dtype.itemsize, len(rows), cards) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


@dataclass
class Spooled:
    """A table whose rows lie in siblings of its file, in their order, until the file is put together."""

    header: bytes
    parts: list[str]
    size: int
    rows: int

    def __iter__(self) -> Iterator[bytes]:
        yield self.header
        for part in self.parts:
            with storage.reading(part) as f:
                while data := f.read(1 << 22):
                    yield data
        yield b"\0" * (-self.size % BLOCK)

    def remove(self) -> None:
        for part in self.parts:
            storage.remove(part)


def spool_table(df, path: str, name: str, columns: list[tuple[str, str]], encode, order: str, cards: dict | None = None) -> Spooled:
    """``df`` as a binary table by ``order``: each task writes a range of it to a sibling of ``path``, a batch in memory at a time; only their names come back.

    ``encode`` makes a structured array of a pandas batch.
    """
    import pandas as pd
    from pyspark import TaskContext

    def run(batches):
        task = TaskContext.get()
        part = f"{path}.{name}-{task.partitionId()}-{task.taskAttemptId()}.part"
        n = size = 0
        with storage.writing(part) as f:
            for pdf in batches:
                rows = encode(pdf)
                f.write(rows.tobytes())
                n, size = n + len(rows), rows.dtype.itemsize
        yield pd.DataFrame({"k": [task.partitionId()], "part": [part], "n": [n], "size": [size]})

    parts = sorted(df.orderBy(order).mapInPandas(run, "k int, part string, n long, size int").collect())  # a row a task
    size = max((r["size"] for r in parts), default=0) or encode(df.limit(0).toPandas()).dtype.itemsize
    n = sum(r["n"] for r in parts)
    return Spooled(table_header(name, columns, size, n, cards), [r["part"] for r in parts], n * size, n)


def write_bytes(path: str, parts: Iterator[bytes], overwrite: bool = True) -> None:
    """A file published whole: a sibling is written, closed and moved; a failed one leaves nothing."""
    if not overwrite and storage.exists(path):
        raise FileExistsError(path)
    part = f"{path}.{os.getpid()}.part"
    try:
        with storage.writing(part) as f:
            for x in parts:
                f.write(x)
        storage.publish(part, path, overwrite)
    finally:
        storage.remove(part)


def write_file(path: str, planes_: list[tuple[str, np.ndarray, dict]], overwrite: bool = True, tables: list[bytes] = ()) -> None:
    """A file of planes (name, data, cards) and of tables, published whole. ``EXTVER`` among a plane's cards is its version."""

    def parts():
        for k, (name, data, cards) in enumerate(planes_):
            version = cards.get("EXTVER")
            yield encode_plane(data, cards, k == 0, name if k else "", None if version is None else int(version))
        yield from tables

    write_bytes(path, parts(), overwrite)


def plane_header(width: int, height: int, exact: bool, cards: dict, first: bool, name: str) -> bytes:
    """The header alone of a plane whose samples follow elsewhere."""
    one = encode_plane(np.zeros((1, 1), dtype=np.int32 if exact else np.float32), cards, first, name)
    text = one[: len(one) - BLOCK]
    return text.replace(card("NAXIS1", 1), card("NAXIS1", width)).replace(card("NAXIS2", 1), card("NAXIS2", height))


def write_sorted(df, path: str, width: int, height: int, columns: list[tuple[str, str, bool]], cards: dict | None = None, extra: list[bytes | Spooled] = ()) -> int:
    """Pixel rows (x, y and the columns) as one file of planes (column, name, exact), a row of pixels in memory at a time.

    Rows come sorted to one task, which spools each plane to a sibling in the store and joins them at the end. Pixels that
    no row has are NaN, or 0 in exact planes; those outside the canvas are left out. Returns how many were written.
    """
    import pandas as pd

    def run(batches):
        spools = [f"{path}.plane-{k}.part" for k in range(len(columns))]
        files = [storage.writing(p) for p in spools]
        blank = lambda exact: np.zeros(width, dtype=">i4") if exact else np.full(width, np.nan, dtype=">f4")
        at, n, row = 0, 0, [blank(e) for _, _, e in columns]

        def advance(to: int):
            nonlocal at, row
            while at < to:
                for f, values in zip(files, row):
                    f.write(values.tobytes())
                at, row = at + 1, [blank(e) for _, _, e in columns]

        try:
            for pdf in batches:
                pdf = pdf[(pdf["x"] >= 0) & (pdf["x"] < width) & (pdf["y"] >= 0) & (pdf["y"] < height)]
                for y, own in pdf.groupby("y", sort=True):
                    advance(int(y))
                    x = own["x"].to_numpy()
                    for (column, _, _), values in zip(columns, row):
                        values[x] = own[column].to_numpy()
                    n += len(own)
            advance(height)
            for f in files:
                f.close()

            def parts():
                for k, ((_, name, exact), spool) in enumerate(zip(columns, spools)):
                    yield plane_header(width, height, exact, (cards or {}) if k == 0 else {}, k == 0, name if k else "")
                    with storage.reading(spool) as f:
                        while data := f.read(1 << 22):
                            yield data
                    yield b"\0" * (-4 * width * height % BLOCK)
                for table in extra:
                    yield from [table] if isinstance(table, bytes) else table

            write_bytes(path, parts())
        finally:
            for p in spools:
                storage.remove(p)
        yield pd.DataFrame({"pixels": [n]})

    ordered = df.select("x", "y", *[c for c, _, _ in columns]).orderBy("y", "x").coalesce(1)
    return ordered.mapInPandas(run, "pixels long").first()["pixels"]


def write_frames(df, folder: str, width: int, height: int, planes_: tuple[str, ...] = ("v",), exact: tuple[str, ...] = ()):
    """A file a frame from pixel rows (frame, x, y, planes...), each written by one task; returns (frame, path, pixels).

    A frame is one group: its size is the raster's, which the caller states and so bounds.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frame = int(pdf["frame"].iloc[0])
        out = []
        for name in planes_:
            g = np.zeros((height, width), dtype=np.int32) if name in exact else np.full((height, width), np.nan, dtype=np.float32)
            g[pdf["y"], pdf["x"]] = pdf[name]
            out.append((name.upper(), g, {"FRAME": frame}))
        path = f"{folder.rstrip('/')}/frame-{frame:06d}.fits"
        write_file(path, out)
        return pd.DataFrame({"frame": [frame], "path": [path], "pixels": [len(pdf)]})

    return df.select("frame", "x", "y", *planes_).groupBy("frame").applyInPandas(run, "frame long, path string, pixels long")
