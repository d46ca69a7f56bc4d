"""``tiffvol``: labelled TIFF stacks, with optional intensity stacks, as a voxel relation.

One input partition covers a few pages of one session, so a large stack is read by many tasks. The
label page decides which voxels are read: background never leaves the reader, and the intensities
of the same page are attached on the spot, so no join over whole image volumes is needed.

A job on the executors follows the page directories of all stacks first; a partition then carries the
place of its first page's directory and reads no other. Only the columns of the reader's schema are
read, so a scan without intensities opens no image. Filters on ``session_id``, ``z`` and ``y`` skip
sessions, pages and rows of strips or tiles; those on ``x`` and ``label`` drop voxels inside the reader.

Paths must be visible to every executor (a shared mount).
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

# Fixed values of the file format: tag numbers, field sizes and sample formats.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR = (
    256, 257, 258, 259, 273, 277, 278, 279, 317,
)
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
NO_PREDICTOR, HORIZONTAL = 1, 2
LARGEST_LABEL = 2**31 - 1
FIELD_SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
KINDS = {1: "u", 2: "i", 3: "f"}
UNCOMPRESSED, DEFLATE_CODES = 1, (8, 32946)
# Pixels looked at in one step; only the size of the batches depends on it.
STEP_PIXELS = 1 << 20


@dataclass(frozen=True)
class Page:
    """Location and layout of one page. Its blocks are strips or tiles of ``block`` rows and columns."""

    height: int
    width: int
    dtype: str
    compression: int
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    block: tuple[int, int]
    tiled: bool = False
    predictor: int = NO_PREDICTOR


@dataclass(frozen=True)
class Form:
    """Byte order and word size of a file, and where its first page directory is."""

    order: str
    big: bool
    first: int

    @property
    def word(self) -> tuple[str, int]:
        return ("Q", 8) if self.big else ("I", 4)


def read_form(f: BinaryIO, path: str) -> Form:
    f.seek(0)
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError(f"not a TIFF file: {path}")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    (first,) = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])
    return Form(order, big, first)


def _entries(f: BinaryIO, form: Form, position: int) -> int:
    f.seek(position)
    (n,) = struct.unpack(form.order + ("Q" if form.big else "H"), f.read(8 if form.big else 2))
    return n


def page_offsets(path: str) -> list[int]:
    """Where the directory of every page begins; nothing but the links between them is read."""
    with open(path, "rb") as f:
        form = read_form(f, path)
        code, width = form.word
        position, found, seen = form.first, [], set()
        while position:
            if position in seen:
                raise ValueError(f"the page directories run in a circle: {path}")
            seen.add(position)
            found.append(position)
            n = _entries(f, form, position)
            f.seek(n * (20 if form.big else 12), 1)
            (position,) = struct.unpack(form.order + code, f.read(width))
    return found


def read_directory(f: BinaryIO, form: Form, position: int, path: str) -> tuple[Page, int]:
    """The page whose directory is at ``position``, and the position of the next one."""
    code, width = form.word
    n, size = _entries(f, form, position), 20 if form.big else 12
    raw = f.read(n * size)
    (following,) = struct.unpack(form.order + code, f.read(width))
    tags = {}
    for i in range(n):
        entry = raw[i * size:(i + 1) * size]
        tag, kind = struct.unpack(form.order + "HH", entry[:4])
        (count,) = struct.unpack(form.order + code, entry[4:4 + width])
        if kind not in FIELD_SIZES:
            continue
        letter, item = FIELD_SIZES[kind]
        data = entry[4 + width:]
        if count * item > width:
            f.seek(struct.unpack(form.order + code, data)[0])
            data = f.read(count * item)
        tags[tag] = struct.unpack(f"{form.order}{count}{letter}", data[:count * item])
    kind = KINDS[tags.get(SAMPLE_FORMAT, (1,))[0]]
    bits = tags.get(BITS, (1,))[0]
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"unsupported sample size of {bits} bits: {path}")
    compression = tags.get(COMPRESSION, (1,))[0]
    if compression != UNCOMPRESSED and compression not in DEFLATE_CODES:
        raise ValueError(f"unsupported compression {compression}: {path}")
    if tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError(f"pages with several samples per pixel are not supported: {path}")
    predictor = tags.get(PREDICTOR, (NO_PREDICTOR,))[0]
    if predictor != NO_PREDICTOR and (predictor != HORIZONTAL or kind == "f"):
        raise ValueError(f"unsupported predictor {predictor}: {path}")
    tall, wide = tags[HEIGHT][0], tags[WIDTH][0]
    tiled = TILE_WIDTH in tags
    if tiled and not {TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS} <= tags.keys():
        raise ValueError(f"a tiled page without the places of its tiles: {path}")
    if tiled:
        block, offsets, counts = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        block = (max(1, min(tall, tags.get(ROWS_PER_STRIP, (tall,))[0])), wide)
        offsets, counts = tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    page = Page(tall, wide, f"{form.order}{kind}{bits // 8}", compression, offsets, counts, block, tiled, predictor)
    return page, following


def read_pages(path: str, start: int | None = None, count: int | None = None) -> list[Page]:
    """Page directories of a TIFF or BigTIFF file: all, or ``count`` from the one at ``start``; only headers are read."""
    pages = []
    with open(path, "rb") as f:
        form = read_form(f, path)
        position = form.first if start is None else start
        while position and (count is None or len(pages) < count):
            page, position = read_directory(f, form, position, path)
            pages.append(page)
    return pages


class Pixels:
    """Pixels of a page by ranges of rows. The last row of blocks stays decoded, so that a walk decodes each once."""

    def __init__(self, f: BinaryIO, page: Page, path: str) -> None:
        self.f, self.page, self.path = f, page, path
        self.across = -(-page.width // page.block[1])
        blocks = self.across * -(-page.height // page.block[0])
        if len(page.offsets) != blocks:
            raise ValueError(f"a page has {len(page.offsets)} blocks instead of {blocks}: {path}")
        self.held: tuple[int, np.ndarray] | None = None

    def block(self, number: int, rows: int) -> np.ndarray:
        """One strip of ``rows`` rows or one tile."""
        page, dtype = self.page, np.dtype(self.page.dtype)
        self.f.seek(page.offsets[number])
        data = self.f.read(page.counts[number])
        if page.compression != UNCOMPRESSED:
            data = zlib.decompress(data)
        shape = page.block if page.tiled else (rows, page.width)
        if len(data) != shape[0] * shape[1] * dtype.itemsize:
            raise ValueError(f"a block holds {len(data)} bytes instead of {shape[0] * shape[1] * dtype.itemsize}: {self.path}")
        pixels = np.frombuffer(data, dtype=dtype).reshape(shape)
        # The horizontal predictor stores the difference to the pixel on the left, modulo the sample size.
        return np.cumsum(pixels, axis=1, dtype=dtype.newbyteorder("=")) if page.predictor == HORIZONTAL else pixels

    def band(self, number: int) -> np.ndarray:
        """One row of blocks over the whole width."""
        if self.held is None or self.held[0] != number:
            rows = min(self.page.block[0], self.page.height - number * self.page.block[0])
            found = [self.block(number * self.across + i, rows) for i in range(self.across)]
            whole = found[0] if len(found) == 1 else np.concatenate(found, axis=1)
            self.held = number, whole[:rows, :self.page.width]
        return self.held[1]

    def rows(self, first: int, last: int) -> np.ndarray:
        step, parts = self.page.block[0], []
        for number in range(first // step, -(-last // step)):
            parts.append(self.band(number)[max(0, first - number * step):last - number * step])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_page(path: str, page: Page) -> np.ndarray:
    """Pixels of one page."""
    with open(path, "rb") as f:
        return Pixels(f, page, path).rows(0, page.height)


SCHEMA = "session_id string, z int, y int, x int, label int, red double, green double"
MASK_COLUMNS = ("session_id", "z", "y", "x", "label")
CHANNELS = ("red", "green")
TESTS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less,
         LessThanOrEqual: np.less_equal, In: np.isin}


def stack_index(path: str, pages_per_task: int) -> dict:
    """Size of a stack, and the place of the directory of every ``pages_per_task``-th page."""
    offsets = page_offsets(path)
    first = read_pages(path, count=1)
    height, width = (first[0].height, first[0].width) if first else (0, 0)
    return {"pages": len(offsets), "height": height, "width": width, "starts": offsets[::pages_per_task]}


class Slab(InputPartition):
    """Some pages of one session, from page ``first`` on; ``starts`` has the place of its directory by file."""

    def __init__(self, session: dict, first: int, wanted: list[int], starts: dict[str, int]) -> None:
        self.session, self.first, self.wanted, self.starts = session, first, wanted, starts


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.sessions = json.loads(options["sessions"])
        self.pages_per_task = int(options.get("pagespertask", "4"))
        self.columns = schema.names
        self.channels = [c for c in CHANNELS if c in self.columns]
        self.filters: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0]
            if isinstance(f, IsNotNull) and column in MASK_COLUMNS:
                continue
            if type(f) not in TESTS or column not in MASK_COLUMNS or column == "session_id" and not isinstance(f, (EqualTo, In)):
                yield f
            else:
                self.filters.append((column, TESTS[type(f)], list(f.value) if isinstance(f, In) else f.value))

    def passing(self, column: str, values) -> np.ndarray:
        """Which ``values`` of a column pass all filters on it."""
        values = np.asarray(values)
        keep = np.ones(len(values), bool)
        for name, test, value in self.filters:
            if name == column:
                keep &= test(values, value)
        return keep

    def partitions(self) -> list[Slab]:
        slabs = []
        for session in self.sessions:
            if not self.passing("session_id", [session["session_id"]])[0]:
                continue
            files = [c for c in ("mask", *self.channels) if session.get(c)]
            index = {c: (session.get("index") or {}).get(c) or stack_index(session[c], self.pages_per_task) for c in files}
            size = [index["mask"][k] for k in ("pages", "height", "width")]
            for c in files:
                if [index[c][k] for k in ("pages", "height", "width")] != size:
                    raise ValueError(f"session {session['session_id']}: {c} image and mask differ in shape")
            own = {k: v for k, v in session.items() if k != "index"}
            for i, first in enumerate(range(0, size[0], self.pages_per_task)):
                pages = np.arange(first, min(first + self.pages_per_task, size[0]))
                wanted = pages[self.passing("z", pages)].tolist()
                if wanted:
                    slabs.append(Slab(own, first, wanted, {c: index[c]["starts"][i] for c in files}))
        return slabs

    def read(self, partition: Slab | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no page passes the filters
            return
        session = partition.session
        count = partition.wanted[-1] - partition.first + 1
        files = {c: open(session[c], "rb") for c in partition.starts}
        try:
            pages = {c: read_pages(session[c], start, count) for c, start in partition.starts.items()}
            for z in partition.wanted:
                yield from self.read_plane(session, z, {
                    c: Pixels(files[c], own[z - partition.first], session[c]) for c, own in pages.items()
                })
        finally:
            for f in files.values():
                f.close()

    def read_plane(self, session: dict, z: int, pixels: dict[str, Pixels]) -> Iterator[pa.RecordBatch]:
        page = pixels["mask"].page
        for c, own in pixels.items():
            if (own.page.height, own.page.width) != (page.height, page.width):
                raise ValueError(f"session {session['session_id']}: {c} image and mask differ in shape")
        name = session["session_id"]
        step = max(1, STEP_PIXELS // max(1, page.width))
        for top in range(0, page.height, step):
            bottom = min(top + step, page.height)
            inside = self.passing("y", np.arange(top, bottom))
            if not inside.any():
                continue
            mask = pixels["mask"].rows(top, bottom)
            if mask.dtype.kind == "f":
                raise ValueError(f"session {name}: mask labels must be integers")
            if mask.dtype.kind == "i" and mask.size and mask.min() < 0:
                raise ValueError(f"session {name}: negative mask label")
            if mask.size and mask.max() > LARGEST_LABEL:
                raise ValueError(f"session {name}: mask label over {LARGEST_LABEL}")
            y, x = np.nonzero(mask)
            keep = inside[y] & self.passing("x", x) & self.passing("label", mask[y, x])
            y, x = y[keep], x[keep]
            n = len(y)
            if not n:
                continue
            made = {"session_id": lambda: pa.array([name] * n, pa.string()), "z": lambda: pa.array(np.full(n, z, np.int32)),
                    "y": lambda: pa.array((y + top).astype(np.int32)), "x": lambda: pa.array(x.astype(np.int32)),
                    "label": lambda: pa.array(mask[y, x].astype(np.int32))}
            columns = []
            for column in self.columns:
                if column in made:
                    columns.append(made[column]())
                elif column in pixels:
                    columns.append(pa.array(pixels[column].rows(top, bottom)[y, x].astype(np.float64)))
                else:
                    columns.append(pa.nulls(n, pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=self.columns)


class TiffVolumes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiffvol"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> VolumeReader:
        return VolumeReader(self.options, schema)


def index_stacks(spark: SparkSession, sessions: list[dict], files: Sequence[str], pages_per_task: int) -> DataFrame:
    """(session_id, file, pages, height, width, starts) of the named files of every session, read on the executors."""
    rows = [(s["session_id"], c, s[c]) for s in sessions for c in files if s.get(c)]
    schema = "session_id string, file string, pages int, height int, width int, starts array<long>"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{**r, **stack_index(r.pop("path"), pages_per_task)} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(found, pa.schema([
                ("session_id", pa.string()), ("file", pa.string()), ("pages", pa.int32()), ("height", pa.int32()),
                ("width", pa.int32()), ("starts", pa.list_(pa.int64())),
            ]))

    tasks = max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(rows, "session_id string, file string, path string").repartition(tasks).mapInArrow(look, schema)


def read_voxels(
    spark: SparkSession, sessions: list[dict], pages_per_task: int = 4, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Foreground voxels of ``sessions``: dicts with ``session_id``, ``mask`` and optional ``red``, ``green``.

    ``columns`` names the columns to read; an intensity that is not among them costs nothing. The driver gets
    one number for each file and partition from the index job.
    """
    spark.dataSource.register(TiffVolumes)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    fields = [f for f in SCHEMA.split(", ") if columns is None or f.split()[0] in columns]
    files = ["mask", *[c for c in CHANNELS if columns is None or c in columns]]
    index: dict[str, dict] = {}
    for r in index_stacks(spark, sessions, files, pages_per_task).toLocalIterator():
        index.setdefault(r.session_id, {})[r.file] = {
            "pages": r.pages, "height": r.height, "width": r.width, "starts": list(r.starts)}
    planned = [{**s, "index": index.get(s["session_id"], {})} for s in sessions]
    return (
        spark.read.format("tiffvol")
        .schema(", ".join(fields))
        .option("sessions", json.dumps(planned))
        .option("pagespertask", str(pages_per_task))
        .load()
    )


def read_volumes(spark: SparkSession, sessions: list[dict]) -> DataFrame:
    """Dimensions of every stack, from the page directories."""
    return index_stacks(spark, sessions, ["mask"], 1 << 30).selectExpr("session_id", "pages AS nz", "height AS ny", "width AS nx")
