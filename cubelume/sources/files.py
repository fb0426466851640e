"""Catalogues, text sources, hashes, exports, and what is kept in files: frames, sessions, records, metadata."""

from __future__ import annotations

import hashlib
import struct
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import numbered, running
from ..runtime import kept


# ---- catalogues
def search(items: DataFrame, name: str, tags: Column, text: str, any_tag: tuple[str, ...]) -> DataFrame:
    """Items whose name has the text and a tag of which has one of any_tag, without case."""
    tagged = F.exists(tags, lambda t: F.greatest(*[F.contains(F.lower(t), F.lit(x)) for x in (any_tag * 2)[: max(2, len(any_tag))]]))
    return items.where(F.contains(F.lower(name), F.lit(text.lower())) & tagged)


def places(items: DataFrame, key: str, orders: dict[str, list[Column]], k: int) -> DataFrame:
    """key and its place in each order, of all that are in the first k of any; ties go by key. The rows are numbered in each order by ranges (no global
    window); the keys that are kept, k for each order at most, are broadcast to the orders."""
    found = {c: kept(numbered(items, *order, key, out=c).select(key, c), "places") for c, order in orders.items()}
    ids = reduce(DataFrame.union, [p.where(F.col(c) <= k).select(key) for c, p in found.items()]).distinct()
    out = ids
    for p in found.values():
        out = out.join(p.join(F.broadcast(ids), key, "left_semi"), key)
    return out.select(key, *[F.col(c).cast("int").alias(c) for c in orders])


def sorted_tops(orders: DataFrame, k: int) -> DataFrame:
    by = {"newest": [F.desc("o_orderdate")], "oldest": [F.col("o_orderdate")], "largest": [F.desc("o_totalprice")], "name": [F.col("o_orderpriority")]}
    return places(orders.select(F.col("o_orderkey").alias("id"), "o_orderdate", "o_totalprice", "o_orderpriority"), "id", by, k)


# fixed values: widths up to which an item is small and from which it is large
SMALL, LARGE = 80, 128


def gallery_orders() -> dict[str, list[Column]]:
    """The five orders of a gallery of items with created, bytes and frames."""
    return {"date_newest": [F.desc("created")], "date_oldest": [F.col("created")], "size_smallest": [F.col("bytes")], "size_largest": [F.desc("bytes")], "frame_count": [F.desc("frames")]}


def gallery(items: DataFrame, size: str = "all", order: str | None = None, key: str = "id") -> DataFrame:
    """Items of a size (all, small, large; by width), in one of gallery_orders(), ties by key. An item without a width is in all only."""
    where = {"all": F.lit(True), "small": F.col("width") <= SMALL, "large": F.col("width") >= LARGE}[size]
    return items.where(where) if order is None else items.where(where).orderBy(*gallery_orders()[order], key)


def capture_statistics(frames: DataFrame, by: str, ts: str, target: int) -> DataFrame:
    """by, frames, target, complete, seconds (from the first frame to the last) and fps (0 where no time has passed). Frames without a time count as frames."""
    s = frames.groupBy(by).agg(F.count("*").alias("frames"), (F.max(ts) - F.min(ts)).cast("interval second").cast("decimal(20,6)").cast("double").alias("seconds"))
    seconds = F.coalesce("seconds", F.lit(0.0))
    return s.select(by, "frames", F.lit(target).alias("target"), (F.col("frames") >= target).alias("complete"), seconds.alias("seconds"), F.when(seconds > 0, F.col("frames") / seconds).otherwise(0.0).alias("fps"))


def byte_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(F.floor(n / 1024).cast("string"), F.lit(" KB")))


def retained(items: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows of the last days before the newest."""
    last = items.agg(F.max(ts).alias("__last"))
    return items.crossJoin(F.broadcast(last)).where(F.col(ts) >= F.col("__last") - F.expr(f"INTERVAL {days} DAYS")).drop("__last")


def current_palette(frames: DataFrame, by: str, order: list[str], default: int = 0) -> DataFrame:
    """ref: the last switch up to each frame, for streams of any length."""
    d = running(frames, [by], order, __ref=("last", "switch"))
    return d.withColumn("ref", F.coalesce("__ref", F.lit(default)).cast("int")).drop("__ref")


# ---- text sources
def scraped(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    return pages.select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.regexp_count(html, F.lit("<p[ >]")).cast("long").alias("paragraphs"))


def named_array(text: Column, name: str) -> Column:
    """Whole numbers of `name = [1, 2, ...]` in a script."""
    body = F.regexp_extract(text, name + r"\s*=\s*\[([^\]]*)\]", 1)
    return F.transform(F.filter(F.split(body, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("int"))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


# ---- hashes
def hash_chain(items: DataFrame, by: str, key: str, data: str) -> DataFrame:
    """by, the hash of its items' hashes in order of key, and that chained with the one before."""
    h = items.select(by, F.struct(key, F.sha2(data, 256).alias("h")).alias("e")).groupBy(by).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["h"]), ""), 256).alias("files"))
    return h.withColumn("chained", F.sha2(F.concat("files", F.coalesce(F.lag("files").over(Window.orderBy(by)), F.lit(""))), 256))


def manifest(tables: dict[str, DataFrame]) -> list[dict]:
    """Name, rows and an order-free digest of each layer; the digest of the one before is chained in."""
    out, before = [], ""
    for name, df in tables.items():
        r = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
        before = f"{name}:{r.n}:{r.s}:{before}"
        out.append({"layer": name, "rows": r.n, "chain": hashlib.sha256(before.encode()).hexdigest()})
    return out


# ---- exports
def point_cloud(cube: DataFrame, stride: int) -> DataFrame:
    keep = cube.where((F.col("f") % stride == 0) & (F.col("y") % stride == 0) & (F.col("x") % stride == 0))
    return keep.select(F.format_string("%d %d %d %d %d %d", "x", "y", "f", "r", "g", "b").alias("line"))


def ply(cube: DataFrame, stride: int, to: str) -> None:
    """Points as text files; the header is a file of its own that sorts before them."""
    lines = point_cloud(cube, stride)
    head = ["ply", "format ascii 1.0", f"element vertex {lines.count()}", *[f"property float {c}" for c in "xyz"], *[f"property uchar {c}" for c in ("red", "green", "blue")], "end_header"]
    cube.sparkSession.createDataFrame([(x,) for x in head], "line string").coalesce(1).write.text(f"{to}/0-head")
    lines.write.text(f"{to}/1-points")


def move_text(events: DataFrame, most: int | None = None) -> DataFrame:
    """user_id and its moves (or the first most of them) as a game record of alternating colours on a 9 by 9 board."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    m = events.withColumn("k", F.row_number().over(w))
    m = m if most is None else m.where(F.col("k") <= most)
    at = lambda v: F.char((97 + v).cast("int"))
    one = F.concat(F.lit(";"), F.when(F.col("k") % 2 == 1, "B").otherwise("W"), F.lit("["), at(F.col("event_id") % 9), at(F.floor(F.col("event_id") / 9) % 9), F.lit("]"))
    moves = F.sort_array(F.collect_list(F.struct("k", one.alias("m"))))
    return m.groupBy("user_id").agg(F.concat(F.lit("(;GM[1]SZ[9]"), F.array_join(F.transform(moves, lambda e: e["m"]), ""), F.lit(")")).alias("sgf"))


def palette_csv(palette: DataFrame, to: str) -> None:
    palette.orderBy("idx").coalesce(1).write.option("header", True).csv(to)


# ---- layers and sessions in a store
def write_layer(df: DataFrame, root: str, session: str, layer: str) -> None:
    """A layer of a session: Parquet under root/session=.../layer=..., so that both prune."""
    df.write.mode("overwrite").parquet(f"{root}/session={session}/layer={layer}")


def read_layer(spark: SparkSession, root: str, session: str, layer: str) -> DataFrame:
    return spark.read.parquet(f"{root}/session={session}/layer={layer}")


def list_sessions(spark: SparkSession, root: str) -> DataFrame:
    """session, files, bytes, changed: newest first, from the files' metadata alone."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root).drop("content")
    s = f.select(F.regexp_extract("path", "/session=([^/]*)/", 1).alias("session"), "length", "modificationTime")
    return s.where("session <> ''").groupBy("session").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("changed")).orderBy(F.desc("changed"), F.desc("session"))


def delete_session(spark: SparkSession, root: str, session: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/session={session}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def export_session(layers: dict[str, DataFrame], root: str, session: str, wanted: set[str] | None = None) -> list[dict]:
    """Writes the wanted layers, and gives the manifest of them."""
    chosen = {k: v for k, v in layers.items() if wanted is None or k in wanted}
    for k, v in chosen.items():
        write_layer(v, root, session, k)
    return manifest(chosen)


# ---- fixed-width records
RECORD = "<HHHHqq"


def packed_cells(cells: DataFrame) -> DataFrame:
    """cell and its 24 bytes: cell, r, g, b (16 bits each), n and w (64 bits each), so that records give back what went in."""

    def pack(d: pd.DataFrame) -> pd.Series:
        return pd.Series([struct.pack(RECORD, c, r, g, b, n, w) for c, r, g, b, n, w in d.itertuples(index=False)])

    return cells.select("cell", F.pandas_udf(pack, "binary")(F.struct("cell", "r", "g", "b", "n", "w")).alias("record"))


def unpacked_cells(records: DataFrame) -> DataFrame:
    def unpack(s: pd.Series) -> pd.DataFrame:
        rows = [struct.unpack(RECORD, bytes(b)) for b in s]
        return pd.DataFrame(rows, columns=["cell", "r", "g", "b", "n", "w"]).astype("int64")

    return records.select(F.pandas_udf(unpack, "cell long, r long, g long, b long, n long, w long")(F.col("record")).alias("x")).select("x.*")


# ---- image metadata
TIFF = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "taken", 0x0100: "width", 0x0101: "height", 0x0102: "bits", 0x0103: "compression", 0x0106: "photometric", 0x0115: "samples", 0xC612: "dng_version", 0x0131: "software"}


def tiff_tags(data: bytes) -> dict:
    """Twelve nullable fields of the first directory of a TIFF, DNG or EXIF block; none of them where the bytes are something else."""
    out: dict = dict.fromkeys(TIFF.values())
    start = data.find(b"Exif\0\0") + 6 if data[:2] == b"\xff\xd8" and b"Exif\0\0" in data else 0
    data = data[start:]
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        return out
    try:
        (at,) = struct.unpack_from(order + "I", data, 4)
        (n,) = struct.unpack_from(order + "H", data, at)
        for i in range(n):
            tag, kind, count, value = struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * i)
            if tag not in TIFF:
                continue
            if kind == 2:
                (o,) = struct.unpack(order + "I", value)
                raw = value[:count] if count <= 4 else data[o : o + count]
                out[TIFF[tag]] = raw.split(b"\0")[0].decode("latin-1")
            elif kind == 3:
                out[TIFF[tag]] = str(struct.unpack(order + "H", value[:2])[0])
            elif kind == 4:
                out[TIFF[tag]] = str(struct.unpack(order + "I", value)[0])
            elif kind == 1:
                out[TIFF[tag]] = ".".join(map(str, value[:count]))
    except struct.error:
        pass
    return out


def image_metadata(files: DataFrame) -> DataFrame:
    """path, length, valid and the twelve fields of binary files."""
    names = list(TIFF.values())

    def each(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tiff_tags(bytes(b)) for b in s], columns=names).astype(object)

    tags = F.pandas_udf(each, ", ".join(f"{n} string" for n in names))(F.col("content"))
    out = files.select("path", "length", tags.alias("t")).select("path", "length", "t.*")
    return out.withColumn("valid", F.col("width").isNotNull() & F.col("height").isNotNull())


def metadata_summary(meta: DataFrame) -> DataFrame:
    return meta.agg(F.count("*").alias("files"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


# ---- records as JSON
def save_json(df: DataFrame, to: str) -> None:
    df.write.mode("overwrite").json(to)


def load_json(spark: SparkSession, at: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(at)
