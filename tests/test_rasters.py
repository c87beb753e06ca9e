import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from huemill.operators import raster
from huemill.sources import rasters


def image(seed, h, w):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def save(folder, name, a, comment=b""):
    (folder / f"{name}.ppm").write_bytes(b"P6\n" + comment + f"{a.shape[1]} {a.shape[0]}\n255\n".encode() + a.tobytes())


def rows_of(a, img, y0=0, y1=None, x0=0, x1=None):
    part = a[y0:y1, x0:x1].astype(int)
    return sorted((img, y0 + y, x0 + x, *map(int, part[y, x])) for y in range(part.shape[0]) for x in range(part.shape[1]))


@pytest.fixture
def folder(tmp_path):
    save(tmp_path, "p1", image(1, 40, 30), b"# made by hand\n")
    save(tmp_path, "p%2F2", image(2, 7, 90))
    save(tmp_path, "p3", image(3, 200, 50))
    (tmp_path / "notes.txt").write_text("no image")
    return tmp_path


def test_all_pixels(spark, folder):
    got = sorted(map(tuple, rasters.pages(spark, str(folder)).collect()))
    assert got == sorted(rows_of(image(1, 40, 30), "p1") + rows_of(image(2, 7, 90), "p/2") + rows_of(image(3, 200, 50), "p3"))


def test_slice_equals_numpy_slice(spark, folder):
    df = rasters.pages(spark, f"file://{folder}").where("img = 'p3' AND y >= 20 AND y < 31 AND x > 4 AND x <= 9")
    assert sorted(map(tuple, df.collect())) == rows_of(image(3, 200, 50), "p3", 20, 31, 5, 10)
    some = rasters.pages(spark, str(folder)).where("img IN ('p1', 'p/2') AND y = 3 AND r > 100")
    want = [r for r in rows_of(image(1, 40, 30), "p1", 3, 4) + rows_of(image(2, 7, 90), "p/2", 3, 4) if r[3] > 100]
    assert sorted(map(tuple, some.collect())) == sorted(want)
    assert rasters.pages(spark, str(folder)).where("y > 500").count() == 0


class Counting:
    """A file that counts what is read of it."""

    def __init__(self, file):
        self.file, self.bytes, self.reads = file, 0, 0

    def read_at(self, n, at):
        out = self.file.read_at(n, at)
        self.bytes, self.reads = self.bytes + len(out), self.reads + 1
        return out


def reader(path, size, *filters):
    r = rasters.PageReader(str(path), size)
    assert list(r.pushFilters(list(filters))) == []
    return r


def test_a_slice_touches_only_its_tiles(folder):
    """Of 200 rows in 11 bands, rows 30 to 40 lie in two; of these 6 columns of 50 are read."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    r = reader(folder, 3000, EqualTo(("img",), "p3"), GreaterThanOrEqual(("y",), 30), LessThan(("y",), 41), GreaterThanOrEqual(("x",), 5), LessThan(("x",), 11))
    parts = [f for p in r.partitions() for f in p.files]
    assert {f[1] for f in parts} == {"p3"} and len(parts) == 11
    read, found = {}, []
    for path, img, k, of in parts:
        with fs.LocalFileSystem().open_input_file(path) as f:
            c = Counting(f)
            found += [tuple(x.values()) for b in r.band(c, img, k, of) for x in b.to_pylist()]
            read[k] = c.bytes - 256
    assert sorted(found) == rows_of(image(3, 200, 50), "p3", 30, 41, 5, 11)
    assert sum(read.values()) == 11 * 6 * 3 and sum(n > 0 for n in read.values()) == 2


def test_other_filters_go_back():
    from pyspark.sql.datasource import GreaterThan, IsNotNull, StringStartsWith

    r = rasters.PageReader("x", 10)
    f = [GreaterThan(("r",), 5), StringStartsWith(("img",), "p"), IsNotNull(("y",))]
    assert list(r.pushFilters(f)) == f[:2]


def test_round_trip(spark, tmp_path):
    images = {f"a {k}/ü": image(k, 5 + k, 3 + 2 * k) for k in range(6)}
    rows = [r for k, a in images.items() for r in rows_of(a, k)]
    df = spark.createDataFrame(rows, "img string, y long, x long, r long, g long, b long").orderBy(F.rand(1)).repartition(4)
    for _ in range(2):  # the second replaces the first
        rasters.write_pages(df, str(tmp_path / "out"))
    assert sorted(map(tuple, rasters.pages(spark, str(tmp_path / "out")).collect())) == sorted(rows)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(p.name for p in (tmp_path / "out").glob("*.ppm"))
    rasters.write_pages(df.limit(0), str(tmp_path / "none"))
    assert rasters.pages(spark, str(tmp_path / "none")).count() == 0


def test_absent_pixels_are_white(spark, tmp_path):
    rasters.write_pages(spark.createDataFrame([("i", 1, 2, 7, 8, 9)], rasters.SCHEMA), str(tmp_path / "o"))
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in rasters.pages(spark, str(tmp_path / "o")).collect()}
    assert got == {(y, x): (7, 8, 9) if (y, x) == (1, 2) else (255, 255, 255) for y in range(2) for x in range(3)}


def test_bad_files(spark, tmp_path):
    (tmp_path / "x.ppm").write_bytes(b"P5\n1 1\n255\n0")
    with pytest.raises(ValueError):
        rasters.parse_header(b"P6\n1 1\n65535\n")
    with pytest.raises(Exception, match="PPM"):
        rasters.pages(spark, str(tmp_path)).count()


# -- resampling ---------------------------------------------------------------------------------


def loop_resize(a, width, height):
    """Triangle-filter resampling, one axis after the other, in whole numbers of 22 bits, by loops."""

    def axis(size, out):
        scale = size / out
        reach = max(scale, 1.0)
        for o in range(out):
            centre = (o + 0.5) * scale
            low, high = max(0, int(centre - reach + 0.5)), min(size, int(centre + reach + 0.5))
            raw = [max(0.0, 1 - abs((i - centre + 0.5) / reach)) for i in range(low, high)]
            yield low, [int(0.5 + w / sum(raw) * (1 << 22)) for w in raw]

    def along(rows, out):
        made = []
        for row in rows:
            made.append([[min(255, ((1 << 21) + sum(k * int(row[low + i][c]) for i, k in enumerate(ks))) >> 22) for c in range(3)] for low, ks in axis(len(row), out)])
        return made

    wide = along(a.tolist(), width)
    tall = along([list(col) for col in zip(*wide, strict=True)], height)
    return [list(row) for row in zip(*tall, strict=True)]


def pixels(spark, images):
    return spark.createDataFrame([r for k, a in images.items() for r in rows_of(a, k)], rasters.SCHEMA)


@pytest.mark.parametrize("out", [(12, 4), (5, 9), (48, 16)])
def test_resized_equals_loops(spark, out):
    images = {"a": image(1, 33, 41), "b": image(2, 4, 12), "c": image(3, 1, 1), "d": image(4, 2, 100), "e": image(5, 33, 41)}
    got = {}
    for r in raster.resized(pixels(spark, images), *out).collect():
        got[r.img, r.y, r.x] = (r.r, r.g, r.b)
    want = {(k, y, x): tuple(px) for k, a in images.items() for y, row in enumerate(loop_resize(a, *out)) for x, px in enumerate(row)}
    assert got == want


def test_fingerprints_have_144_values(spark):
    images = {"a": image(1, 30, 50), "b": image(2, 9, 9)}
    got = {r.img: list(r.fingerprint) for r in raster.fingerprints(pixels(spark, images)).collect()}
    assert got == {k: [c for row in loop_resize(a, 12, 4) for px in row for c in px] for k, a in images.items()}


def loop_color(a, above, fewest):
    px = [tuple(p) for row in a for p in row]
    beads = [p for p in px if not all(c > above for c in p)]
    beads = px if len(beads) < fewest else beads
    beads.sort(key=sum)
    core = beads[len(beads) // 10 : max(len(beads) * 9 // 10, len(beads) // 10 + 1)]
    return tuple(sum(c[i] for c in core) // len(core) for i in range(3))


def test_photo_and_swatch_colors(spark):
    images = {"a": image(1, 40, 60), "b": np.full((30, 30, 3), 250, np.uint8), "c": image(3, 20, 33)}
    images["b"][10:14, 9:20] = (200, 10, 30)
    photo = {r.img: (r.r, r.g, r.b) for r in raster.photo_colors(pixels(spark, images)).collect()}
    assert photo == {k: loop_color(loop_resize(a, 48, 16), 232, 12) for k, a in images.items()}
    swatch = {r.img: (r.r, r.g, r.b) for r in raster.swatch_colors(pixels(spark, images)).collect()}
    want = {}
    for k, a in images.items():
        m = round(min(a.shape[:2]) * 0.2)
        want[k] = loop_color(loop_resize(a[m : a.shape[0] - m, m : a.shape[1] - m], 32, 32), 236, 32)
    assert swatch == want


def test_crops_of_many_rectangles(spark):
    images = {"a": image(1, 100, 120), "b": image(2, 10, 10)}
    rects = [("a", 1, 3, 5, 70, 40), ("a", 2, 60, 60, 65, 61), ("b", 1, 0, 0, 10, 10), ("a", 3, 119, 99, 500, 500), ("zz", 1, 0, 0, 5, 5)]
    df = spark.createDataFrame(rects, "img string, rect_id int, x0 int, y0 int, x1 int, y1 int")
    got = sorted(map(tuple, raster.crops(pixels(spark, images), df).select("img", "rect_id", "y", "x", "r", "g", "b").collect()))
    want = []
    for img, k, x0, y0, x1, y1 in rects:
        if img in images:
            part = images[img][y0:y1, x0:x1].astype(int)
            want += [(img, k, y, x, *map(int, part[y, x])) for y in range(part.shape[0]) for x in range(part.shape[1])]
    assert got == sorted(want)


def test_pixel_rectangles_are_clamped(spark):
    df = spark.createDataFrame([(1, -5.0, 0.25, 9.99, 500.0), (2, 99.0, 99.0, 99.0, 99.0), (3, 0.06, 0.18, 0.18, 0.3)], "k int, x0 double, y0 double, x1 double, y1 double")
    got = {r.k: (r.x0, r.y0, r.x1, r.y1) for r in raster.to_pixel_rects(df, F.lit(200), F.lit(100), 600).collect()}

    def want(x0, y0, x1, y1, w=200, h=100, s=600 / 72):
        a, b = max(0, min(w - 1, round(x0 * s))), max(0, min(h - 1, round(y0 * s)))
        return a, b, max(a + 1, min(w, round(x1 * s))), max(b + 1, min(h, round(y1 * s)))

    assert got == {1: want(-5.0, 0.25, 9.99, 500.0), 2: want(99, 99, 99, 99), 3: want(0.06, 0.18, 0.18, 0.3)}


@pytest.mark.parametrize("name", ["photo_colors", "swatch_colors", "fingerprint_consensus"])
def test_documents_in_many_strips(spark, name, monkeypatch):
    """Images of several strips give what images of one give."""
    from huemill.plans import raster_queries, registry

    run = lambda: sorted(map(tuple, registry.queries()[name](spark, "/root/testdata/sf0.001").collect()))
    whole = run()
    monkeypatch.setattr(raster_queries, "LINES", 3)
    assert run() == whole and whole


def strips_of(spark, images, lines):
    rows = [(k, t, min(lines, len(a) - t), a.shape[1], len(a), bytearray(a[t : t + lines].tobytes())) for k, a in images.items() for t in range(0, len(a), lines)]
    return spark.createDataFrame(rows, "img string, top int, lines int, width int, height int, data binary")


def test_strips_are_written_as_images(spark, tmp_path):
    """A row of a file's strips, not of its pixels, reaches the writer."""
    images = {f"a {k}/ü": image(k, 5 + 9 * k, 3 + 2 * k) for k in range(6)}
    strips = strips_of(spark, images, 7).orderBy(F.rand(1)).repartition(4)
    for _ in range(2):  # the second replaces the first
        rasters.write_strips(strips, str(tmp_path / "out"))
    want = sorted(r for k, a in images.items() for r in rows_of(a, k))
    assert sorted(map(tuple, rasters.pages(spark, str(tmp_path / "out")).collect())) == want
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(p.name for p in (tmp_path / "out").glob("*.ppm"))
    rasters.write_strips(strips.where("img = 'a 1/ü' AND top = 7"), str(tmp_path / "gap"))
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in rasters.pages(spark, str(tmp_path / "gap")).collect()}
    a = images["a 1/ü"]
    assert got == {(y, x): tuple(map(int, a[y, x])) if y >= 7 else (255, 255, 255) for y in range(14) for x in range(5)}


@pytest.mark.parametrize("lines", [3, 64])
def test_crop_sums(spark, lines, monkeypatch):
    """Sums of rectangles over one strip and over several, and with strips of several batches."""
    monkeypatch.setattr(raster, "CUT_BYTES", 500)
    images = {"a": image(1, 100, 120), "b": image(2, 10, 10)}
    rects = [("a", 1, 3, 5, 70, 40), ("a", 2, 60, 60, 65, 61), ("b", 1, 0, 0, 10, 10), ("b", 4, -2, -5, 3, 4), ("a", 3, 119, 99, 500, 500), ("zz", 1, 0, 0, 5, 5), ("b", 2, 4, 4, 4, 9), ("b", 3, 10, 10, 12, 12)]
    df = spark.createDataFrame(rects, "img string, rect_id int, x0 int, y0 int, x1 int, y1 int")
    found = raster.crop_sums(strips_of(spark, images, lines), df, lines).groupBy("img", "rect_id").agg(*(F.sum(c) for c in ("n", "r", "g", "b")))
    want = []
    for img, k, x0, y0, x1, y1 in rects:
        part = images[img][max(y0, 0) : y1, max(x0, 0) : x1].reshape(-1, 3).astype(int) if img in images else []
        if len(part):
            want.append((img, k, len(part), *map(int, part.sum(axis=0))))
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["page_slices", "page_crops"])
def test_queries_make_no_pixel_rows(spark, name, monkeypatch):
    from huemill.plans import raster_queries, registry

    def no(*_):
        raise AssertionError("a row a pixel")

    monkeypatch.setattr(raster_queries, "document_pixels", no)
    monkeypatch.setattr(raster_queries, "LINES", 3)
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count()


def test_packs_hold_many_images(spark, tmp_path, monkeypatch):
    """Files are as few as their bytes ask for, not one an image, and are read as images are, by name, by rectangle and by band."""
    images = {f"a {k}/ü": image(k, 5 + k % 9, 3 + k % 7) for k in range(80)} | {"n" * 400: image(1, 6, 5)}
    strips = strips_of(spark, images, 4).orderBy(F.rand(1)).repartition(4)
    for _ in range(2):  # the second replaces the first
        rasters.write_packs(strips, str(tmp_path / "out"))
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert files and all(f.endswith(".ppms") for f in files) and len(files) <= 8
    want = sorted(r for k, a in images.items() for r in rows_of(a, k))
    pages = rasters.pages(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, pages.collect())) == want
    inside = lambda r: r[0] in ("a 3/ü", "a 8/ü", "n" * 400) and r[1] >= 2 and r[2] < 3
    assert sorted(map(tuple, pages.where(F.col("img").isin("a 3/ü", "a 8/ü", "n" * 400, "zz") & (F.col("y") >= 2) & (F.col("x") < 3)).collect())) == list(filter(inside, want))
    banded = rasters.use(spark).read.format("page_images").option("partitionBytes", 300).load(str(tmp_path / "out"))
    assert banded.rdd.getNumPartitions() > len(files) and sorted(map(tuple, banded.collect())) == want


def test_slices_need_no_file_an_image(spark, tmp_path, monkeypatch):
    from huemill.plans import raster_queries

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abc"), 48 * 6).alias("text"))
    monkeypatch.setattr(raster_queries, "table", lambda *_: docs)
    monkeypatch.setattr(raster_queries, "shared_folder", lambda _: str(tmp_path / "packs"))
    assert {tuple(r) for r in raster_queries.page_slices(spark, "").select("n", "r", "g", "b").collect()} == {(64, 64 * 97, 64 * 98, 64 * 99)}
    assert len(list((tmp_path / "packs").iterdir())) <= 8
