"""Page rasters: a data source of binary PPM files (P6, 8 bits a channel), one file an image, as long pixels.

    rasters.use(spark)
    spark.read.format("page_images").load(path)        # img, y, x, r, g, b
    rasters.write_pages(pixels, path)                   # from long pixels
    rasters.write_strips(strips, path)                  # from strips of whole lines, which is far less work
    rasters.write_packs(strips, path)                   # the same as packs, for many images

img is the file's name without its ending, percent-decoded. A pack (.ppms) has one image after the other, each with
its name as a comment, so that a driver lists and moves as many files as there are PARTITION_BYTES of them. A file is cut into bands of rows by its size; a
partition holds bands of about partitionBytes. Equalities on img choose files before any is opened, and
bounds on x and y become a rectangle: of each band only the rows in it are read, and of wide pages only the
columns; a pack is gone through from header to header. Files are read at offsets through Arrow's file systems, so that any store that these open will do.

Images without pixels have no rows. A writer's pixel that is absent is white; of several at one place the
last in order counts. A file appears under its name once all tasks have written.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "img string, y int, x int, r int, g int, b int"
STRIPS = "img string, top int, width int, height int, data binary"
ENDING, PACK = ".ppm", ".ppms"
#: Bytes of a partition, and pixels of one batch, at most (a band has one row at least).
PARTITION_BYTES, BATCH_PIXELS = 16 << 20, 1 << 18
FARTHEST = 1 << 31


@dataclass
class Header:
    width: int
    height: int
    offset: int


def parse_header(start: bytes) -> Header:
    """Width, height and the place of the first pixel of a P6 file with 255 levels."""
    found = re.match(rb"P6(?:\s+|\s*#[^\n]*\n)+(\d+)(?:\s+|\s*#[^\n]*\n)+(\d+)(?:\s+|\s*#[^\n]*\n)+255\s", start)
    if not found:
        raise ValueError("not a binary PPM file of 255 levels")
    return Header(int(found[1]), int(found[2]), found.end())


def header_at(file: pa.NativeFile, at: int) -> tuple[Header, str]:
    """The header of the image that starts there, its offset in the file, and the name that its first comment gives."""
    start = file.read_at(256, at)
    if start.startswith(b"P6\n#") and start.find(b"\n255\n") < 0:  # a long name
        start = file.read_at(1 << 16, at)
    head, name = parse_header(start), re.match(rb"P6\n#([^\n]*)\n", start)
    return Header(head.width, head.height, at + head.offset), unquote(name[1].decode()) if name else ""


class Rectangle:
    """Bounds on y and x, both ends included, and the images that are asked for (None: all)."""

    def __init__(self) -> None:
        self.low, self.high, self.images = {"y": 0, "x": 0}, {"y": FARTHEST, "x": FARTHEST}, None

    def take(self, f: Filter) -> bool:
        """Whether the filter is part of the rectangle now."""
        name = f.attribute[0].lower() if len(f.attribute) == 1 else ""
        if isinstance(f, IsNotNull):
            return name in ("img", "y", "x", "r", "g", "b")
        if name == "img" and isinstance(f, EqualTo | In):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.images = values if self.images is None else self.images & values
            return True
        if name not in self.low:
            return False
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            self.high[name] = min(self.high[name], f.value - isinstance(f, LessThan))
        return isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual)


@dataclass
class Bands(InputPartition):
    """(path, img or None for a pack, number of the band, bands of the file)."""

    files: list[tuple[str, str | None, int, int]]


class PageReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int) -> None:
        self.path, self.partition_bytes, self.wanted = path, partition_bytes, Rectangle()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.wanted.take(f)]

    def partitions(self) -> list[Bands]:
        store, root = _store(self.path)
        out, held = [Bands([])], 0
        for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            img = None if info.base_name.endswith(PACK) else unquote(info.base_name.removesuffix(ENDING))
            if info.type != fs.FileType.File or not info.base_name.endswith((ENDING, PACK)) or img is not None and not self.asked(img):
                continue
            of = -(-info.size // self.partition_bytes)
            for k in range(of):
                if held and held + info.size // of > self.partition_bytes:
                    out.append(Bands([]))
                    held = 0
                out[-1].files.append((info.path, img, k, of))
                held += info.size // of
        return out

    def asked(self, img: str) -> bool:
        return self.wanted.images is None or img in self.wanted.images

    def images(self, file: pa.NativeFile, img: str | None) -> Iterator[tuple[str, Header]]:
        """The image of a file, or those of a pack that are asked for."""
        if img is not None:
            yield img, header_at(file, 0)[0]
            return
        at, end = 0, file.size()
        while at < end:
            head, name = header_at(file, at)
            if self.asked(name):
                yield name, head
            at = head.offset + head.width * head.height * 3

    def read(self, partition: Bands) -> Iterator[pa.RecordBatch]:
        """Batches of many small images' bands at once, as each batch has its price."""
        store, _ = _store(self.path)
        held, rows = [], 0
        for path, of_file, k, of in partition.files:
            with store.open_input_file(path) as file:
                for b in (b for img, head in self.images(file, of_file) for b in self.band(file, img, k, of, head)):
                    if rows + b.num_rows > BATCH_PIXELS and held:
                        yield pa.concat_batches(held)
                        held, rows = [], 0
                    held.append(b)
                    rows += b.num_rows
        if held:
            yield pa.concat_batches(held)

    def band(self, file: pa.NativeFile, img: str, k: int, of: int, head: Header | None = None) -> Iterator[pa.RecordBatch]:
        """Batches of one band's part of the rectangle; nothing else of its pixels is read. head: of an image that isn't the file's first."""
        head = head or header_at(file, 0)[0]
        low, high = self.wanted.low, self.wanted.high
        y0, y1 = max(head.height * k // of, low["y"]), min(head.height * (k + 1) // of, high["y"] + 1)
        x0, x1 = max(0, low["x"]), min(head.width, high["x"] + 1)
        if y0 >= y1 or x0 >= x1:
            return
        wide, rows = x1 - x0, max(1, BATCH_PIXELS // (x1 - x0))
        for top in range(y0, y1, rows):
            n = min(rows, y1 - top)
            if 2 * wide >= head.width:
                data = np.frombuffer(file.read_at(n * head.width * 3, head.offset + top * head.width * 3), np.uint8).reshape(n, head.width, 3)[:, x0:x1]
            else:
                lines = [file.read_at(wide * 3, head.offset + ((top + i) * head.width + x0) * 3) for i in range(n)]
                data = np.frombuffer(b"".join(lines), np.uint8).reshape(n, wide, 3)
            y, x = np.indices((n, wide), np.int32)
            columns = [pa.repeat(pa.scalar(img), n * wide), pa.array((y + top).reshape(-1)), pa.array((x + x0).reshape(-1)), *(pa.array(data[:, :, c].reshape(-1).astype(np.int32)) for c in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["img", "y", "x", "r", "g", "b"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class PageWriter(DataSourceArrowWriter):
    """Rows come sorted by img, all of one image in one task; a task holds one image."""

    columns, packs = ("y", "x", "r", "g", "b"), False

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def image(self, parts: list[list[np.ndarray]]) -> np.ndarray:
        y, x, r, g, b = (np.concatenate(c) for c in zip(*parts, strict=True))
        image = np.full((int(y.max()) + 1, int(x.max()) + 1, 3), 255, np.uint8)
        image[y, x] = np.stack([r, g, b], axis=1)
        return image

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        folder, files = f"{root}/_writing-{uuid.uuid4().hex}", []
        open_img, parts, pack, room = None, [], None, 0

        def started(name: str) -> pa.NativeFile:
            if not files:
                store.create_dir(folder)
            files.append((f"{folder}/{name}", f"{root}/{name}"))
            return store.open_output_stream(f"{folder}/{name}")

        def flush() -> None:
            nonlocal pack, room
            if not parts:
                return
            image, name = self.image(parts), quote(open_img, safe="")
            size = f"{image.shape[1]} {image.shape[0]}\n255\n"
            if not self.packs:
                with started(name + ENDING) as out:
                    out.write(f"P6\n{size}".encode() + image.tobytes())
                return
            data = f"P6\n#{name}\n{size}".encode() + image.tobytes()
            if pack is None or room + len(data) > PARTITION_BYTES:
                if pack is not None:
                    pack.close()
                pack, room = started(uuid.uuid4().hex + PACK), 0
            pack.write(data)
            room += len(data)

        for batch in iterator:
            images = batch.column("img").to_pylist()
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in self.columns]
            cuts = [0, *(i for i in range(1, len(images)) if images[i] != images[i - 1]), len(images)] if images else []
            for a, z in zip(cuts, cuts[1:], strict=False):
                if images[a] != open_img:
                    flush()
                    open_img, parts = images[a], []
                parts.append([c[a:z] for c in columns])
        flush()
        if pack is not None:
            pack.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.base_name.endswith((ENDING, PACK)):
                    store.delete_file(info.path)
        for written, name in (pair for m in messages if m for pair in m.files):
            store.move(written, name)
        self._tidy(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self._tidy(messages)

    def _tidy(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for folder in {w.rpartition("/")[0] for m in messages if m for w, _ in m.files}:
            store.delete_dir(folder)


class StripWriter(PageWriter):
    """The same of strips of whole lines."""

    columns = ("top", "width", "height", "data")

    def image(self, parts: list[list[np.ndarray]]) -> np.ndarray:
        top, width, height, data = (np.concatenate(c) for c in zip(*parts, strict=True))
        image = np.full((int(height.max()), int(width.max()), 3), 255, np.uint8)
        for t, w, d in zip(top, width, data, strict=True):
            lines = np.frombuffer(d, np.uint8).reshape(-1, w, 3)
            image[t : t + len(lines), :w] = lines
        return image


class PackWriter(StripWriter):
    """Strips as packs, each of PARTITION_BYTES at most or of one image."""

    packs = True


class PageImages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_images"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"], overwrite)


class PageStrips(PageImages):
    """Files of the same kind, written as strips of whole lines; they are read as page_images."""

    @classmethod
    def name(cls) -> str:
        return "page_strips"

    def schema(self) -> str:
        return STRIPS

    def writer(self, schema, overwrite: bool) -> StripWriter:
        return StripWriter(self.options["path"], overwrite)


class PagePacks(PageStrips):
    """Packs of images, written as strips of whole lines; they are read as page_images."""

    @classmethod
    def name(cls) -> str:
        return "page_packs"

    def writer(self, schema, overwrite: bool) -> PackWriter:
        return PackWriter(self.options["path"], overwrite)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    return store, root.rstrip("/")


def use(spark: SparkSession) -> SparkSession:
    """Makes the source known to a session, and lets filters reach it."""
    spark.dataSource.register(PageImages)
    spark.dataSource.register(PageStrips)
    spark.dataSource.register(PagePacks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def pages(spark: SparkSession, path: str) -> DataFrame:
    return use(spark).read.format("page_images").load(path)


def write_pages(pixels: DataFrame, path: str) -> None:
    """Long pixels (img, y, x, r, g, b) as one file an image; images of the folder that was there go."""
    use(pixels.sparkSession)
    cast = pixels.select("img", *(pixels[c].cast("int").alias(c) for c in ("y", "x", "r", "g", "b")))
    cast.repartition("img").sortWithinPartitions("img", "y", "x").write.format("page_images").mode("overwrite").save(path)


def _write(strips: DataFrame, path: str, kind: str) -> None:
    use(strips.sparkSession)
    cast = strips.select("img", *(strips[c].cast("int").alias(c) for c in ("top", "width", "height")), "data")
    cast.repartition("img").sortWithinPartitions("img", "top").write.format(kind).mode("overwrite").save(path)


def write_strips(strips: DataFrame, path: str) -> None:
    """Strips of whole lines (img, top, width, height, data: three bytes a pixel) as one file an image; images of the folder that was there go."""
    _write(strips, path, "page_strips")


def write_packs(strips: DataFrame, path: str) -> None:
    """The same as packs of many images: files are as many as PARTITION_BYTES of pixels, and a few a task, whatever the number of images."""
    _write(strips, path, "page_packs")
