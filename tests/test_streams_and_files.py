import struct

from pyspark.sql import functions as F

from cubelume.operators.cells import centroids
from cubelume.sources import files
from cubelume.sources.cubes import load, voxels
from cubelume.streaming import streams


def test_stream_windows_equal_batch(spark, sf_dir, tmp_path):
    stream = streams.event_stream(spark, sf_dir)
    got = streams.run_to_table(streams.tumbling(stream, "45 minutes", late="1 day"), "tumble_out", str(tmp_path / "c"))
    want = streams.tumbling(load(spark, sf_dir, "events"), "45 minutes")
    key = lambda df: sorted((r.start, r.n, round(r.total, 6)) for r in df.collect())
    assert key(got) == key(want)


def test_stream_count_windows(spark, sf_dir, tmp_path):
    stream = streams.event_stream(spark, sf_dir)
    out = streams.run_to_table(streams.count_windows(stream, "event_type", F.col("value"), 10), "count_out", str(tmp_path / "c"), "append")
    per = {r.event_type: r["count"] for r in load(spark, sf_dir, "events").groupBy("event_type").count().collect()}
    assert {r.event_type: r.b for r in out.groupBy("event_type").agg(F.count("*").alias("b")).collect()} == {k: n // 10 for k, n in per.items() if n >= 10}
    assert out.where("n != 10").count() == 0


def test_count_batches_are_exact(spark, sf_dir):
    b = streams.batches_of(load(spark, sf_dir, "events"), 7, "ts", "event_id")
    sizes = [r["count"] for r in b.groupBy("batch").count().orderBy("batch").collect()]
    assert set(sizes[:-1]) == {7} and sum(sizes) == load(spark, sf_dir, "events").count()


def test_sessions_in_a_store(spark, sf_dir, tmp_path):
    cells = centroids(voxels(spark, sf_dir))
    m = files.export_session({"cells": cells, "raw": voxels(spark, sf_dir)}, str(tmp_path), "s1", {"cells"})
    assert [x["layer"] for x in m] == ["cells"] and m[0]["rows"] == cells.count()
    assert files.read_layer(spark, str(tmp_path), "s1", "cells").count() == cells.count()
    assert [r.session for r in files.list_sessions(spark, str(tmp_path)).collect()] == ["s1"]
    assert files.delete_session(spark, str(tmp_path), "s1")


def test_records_round_trip(spark, sf_dir):
    cells = centroids(voxels(spark, sf_dir))
    back = files.unpacked_cells(files.packed_cells(cells))
    names = ["cell", "r", "g", "b", "n", "w"]
    assert sorted(map(tuple, back.select(names).collect())) == sorted(map(tuple, cells.select(names).collect()))
    large = spark.createDataFrame([(728, 255, 0, 1, 1 << 40, (1 << 62) + 1)], "cell int, r int, g int, b int, n long, w long")
    assert tuple(files.unpacked_cells(files.packed_cells(large)).first()) == (728, 255, 0, 1, 1 << 40, (1 << 62) + 1)


def test_image_metadata(spark, tmp_path):
    entry = lambda tag, kind, n, v: struct.pack("<HHI4s", tag, kind, n, v)
    body = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + entry(0x0100, 4, 1, struct.pack("<I", 640)) + entry(0x0101, 3, 1, struct.pack("<HH", 480, 0)) + entry(0x010F, 2, 3, b"ab\0\0")
    (tmp_path / "a.dng").write_bytes(body)
    (tmp_path / "b.dng").write_bytes(b"nothing")
    meta = files.image_metadata(spark.read.format("binaryFile").load(str(tmp_path)))
    r = meta.where("valid").first()
    assert (r.width, r.height, r.make, r.model) == ("640", "480", "ab", None)
    assert tuple(files.metadata_summary(meta).first()) == (2, 1, 1)


def test_exports(spark, sf_dir, tmp_path):
    cube = voxels(spark, sf_dir)
    files.ply(cube, 9, str(tmp_path / "p"))
    n = spark.read.text(str(tmp_path / "p" / "1-points")).count()
    assert f"element vertex {n}" in [r.value for r in spark.read.text(str(tmp_path / "p" / "0-head")).collect()]
    files.save_json(load(spark, sf_dir, "events").limit(5), str(tmp_path / "j"))
    assert files.load_json(spark, str(tmp_path / "j"), "event_id long").count() == 5
    df = spark.createDataFrame([("var a = [1, 2,x, 3];",)], "t string")
    assert df.select(files.named_array(F.col("t"), "a").alias("a")).first().a == [1, 2, None, 3]


def test_gif_stream_sink(spark, tmp_path):
    from cubelume.functions import gif
    from cubelume.operators.grouped import rasters
    from cubelume.sources.cubes import dense_cube
    from cubelume.streaming import gif_sink

    cube = dense_cube(spark, "wave", 9).withColumn("idx", (F.col("r") % 64).cast("int"))
    frames = rasters(cube).withColumns({"clip": F.lit("a"), "delay": F.lit(3)})
    frames.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream.writeStream.foreachBatch(gif_sink.appender(out, 9, 9)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    r = gif_sink.end(spark, out, [(i, i, i) for i in range(256)], 9, 9).first()
    assert r.frames == 9 and gif.report(bytes(r.gif))["valid"]
    want = {x.f: bytes(x.indices) for x in frames.collect()}
    assert [f.indices for f in gif.read(bytes(r.gif)).frames] == [want[i] for i in range(9)]
    assert gif_sink.intact(spark, out, frames).count() == 0
