"""Every registered query runs; those with SQL give DuckDB's rows exactly."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from rasterloom import fixtures as fx
from rasterloom import media
from rasterloom import queries as own
from rasterloom.functions import sql
from rasterloom.kernels import dense
from rasterloom.operators import images, px
from rasterloom.plans import lut, morphology
from rasterloom.registry import ALIASES, CLASSES, KERNELS, MODULE_OF
from rasterloom.sources import spark_images
from rasterloom.streaming import frames, windows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_operator_has_a_query():
    assert {f"{MODULE_OF[n]}__{n}" for n in KERNELS if n not in CLASSES} <= set(own.QUERIES)
    assert set(own.ORACLES) <= set(own.QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in own.ORACLES if n.split("__")[1] not in ALIASES])
def test_sql_agrees(spark, duck, name):
    a = own.QUERIES[name](spark, SF).toPandas()
    b = duck.execute(own.ORACLES[name]).df()[list(a.columns)]
    assert len(a) == len(b) > 0
    a, b = (d.sort_values(list(d.columns)).reset_index(drop=True) for d in (a, b))
    for c in a.columns:
        assert (a[c].astype(str) == b[c].astype(str)).all() or np.array_equal(a[c].to_numpy(float), b[c].to_numpy(float)), c


def test_kernels_on_rows_equal_kernels_on_arrays(spark):
    rows = {r.img_id: r for r in images.run(fx.page_images(spark, SF), dense.apply_gaussian_blur, 5, 1.2).collect()}
    for r in fx.page_images(spark, SF).collect():
        a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)
        assert (np.array(rows[r.img_id].v).reshape(a.shape) == dense.apply_gaussian_blur(a, 5, 1.2)).all()


def test_plans(spark):
    chain = [("apply_negative",), ("apply_gamma", 0.5)]
    a = lut.apply(fx.img8(spark, SF), chain)
    b = px.apply_point(px.apply_point(fx.img8(spark, SF), "apply_negative"), "apply_gamma", 0.5)
    assert a.exceptAll(b).count() == 0
    i = fx.images8(spark, SF)
    two, one = morphology.erode(i, 3, 5), images.run(i, dense.apply_erosion, dense.get_structuring_element(0, 3, 5))
    assert two.exceptAll(one).count() == 0


def test_tiles_equal_the_whole(spark):
    k = dense.gaussian_kernel(3, 1.0)
    whole = {r.img_id: dense.apply_filter2d(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width), k) for r in fx.page_images(spark, SF).collect()}
    for t in images.tiles(fx.page_images(spark, SF), 16, 1).collect():
        a = dense.apply_filter2d(np.frombuffer(t.data, np.uint8).reshape(t.height, t.width), k)
        own = whole[t.img_id][t.ty * 16 : t.ty * 16 + 16, t.tx * 16 : t.tx * 16 + 16]
        assert (a[t.top : t.top + own.shape[0], t.left : t.left + own.shape[1]] == own).all()


def test_sql_functions_and_files(spark, tmp_path):
    name = sql.register(spark, "apply_threshold", 127)
    i = fx.images8(spark, SF).where("img_id < 20")
    i.createOrReplaceTempView("shots")
    for r in spark.sql(f"SELECT data, {name}(data, height, width, channels) AS t FROM shots").collect():
        assert bytes(r.t) == bytes(255 if b > 127 else 0 for b in r.data)
    spark_images.write(i.withColumnRenamed("img_id", "name"), str(tmp_path))
    back = spark_images.read(spark, str(tmp_path), -1).collect()
    assert sorted(bytes(r.data) for r in back) == sorted(bytes(r.data) for r in i.collect())


def test_streamed_background_equals_the_batch(spark, tmp_path):
    f = frames.frames(fx.images8(spark, SF).where("img_id < 50"))
    f.write.parquet(str(tmp_path / "in"))
    s = frames.stream_background(spark.readStream.schema(f.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    out, want = spark.read.schema(s.schema).parquet(str(tmp_path / "out")), frames.batch_background(f, "mog2")
    assert out.count() == 50 and out.exceptAll(want).count() == 0


def test_streams_of_several_triggers(spark, tmp_path):
    e = windows.batch(spark, SF)
    e.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "events.parquet"))
    got, want = windows.streamed(spark, str(tmp_path), windows.tumbling, files=1), windows.tumbling(e)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0
    e.limit(0).write.mode("overwrite").parquet(str(tmp_path / "none" / "events.parquet"))
    assert windows.streamed(spark, str(tmp_path / "none"), windows.tumbling).count() == 0


def test_pixel_plans_equal_the_image_kernels(spark):
    """Each operator that has two forms: over pixels in the JVM, and over image rows."""
    i, p, c = fx.images8(spark, SF), fx.img8(spark, SF), fx.rgb_images(spark, SF)
    whole = lambda df: df.select("img_id", "y", "x", "c", px.F.col("v").cast("bigint").alias("v"))
    for a, b in (
        (px.apply_otsu(p), images.to_px(images.run(i, dense.apply_otsu_threshold))),
        (px.equalise(fx.rgb8(spark, SF)), images.to_px(images.run(c, dense.hist_equalize_rgb))),
        (px.integral(p), images.to_px(images.run(i, dense.integral)).where("y > 0 and x > 0")),
        (px.flip(p, 1), px.flip(p, 1, (8, 8))),
        (px.rgb_to_hsv(px.colours(fx.rgb8(spark, SF))), images.to_px(images.run(c, dense.rgb_to_hsv))),
    ):
        a, b = whole(a), whole(b)
        assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0


def test_matches(spark):
    rng = np.random.default_rng(2)
    v = [(i, rng.integers(0, 4, 6).tolist()) for i in range(60)]
    q, t = (spark.createDataFrame(x, "idx bigint, d array<int>") for x in (v[:20], v[20:]))
    for norm in ("L1", "L2", "HAMMING"):
        got = {(r.query_idx, r.rank): (r.train_idx, r.distance) for r in px.match(q, t, 3, norm, block_bytes=400).collect()}
        for i, a in v[:20]:
            d = lambda b, a=a: sum(abs(x - y) if norm == "L1" else (x - y) ** 2 if norm == "L2" else (x ^ y).bit_count() for x, y in zip(a, b, strict=True))
            best = sorted((d(b), j) for j, b in v[20:])[:3]
            assert [got[i, k + 1] for k in range(3)] == [(j, s**0.5 if norm == "L2" else float(s)) for s, j in best]
    far = {r.idx for r in px.unmatched(q, t, 2.0).collect()}
    assert far == {i for i, a in v[:20] if all(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) > 4 for _, b in v[20:])}
    assert px.match(q.limit(0), t).count() == 0


def test_pages_are_read_whole(spark):
    pages = {r.page_id: r.html for r in fx.table(spark, SF, "pages").collect()}
    for r in fx.page_images(spark, SF).collect():
        text = pages[r.img_id]
        assert r.height == -(-len(text) // 64) and bytes(r.data) == bytes(ord(ch) % 256 for ch in text).ljust(64 * r.height, b"\0")


def test_cascade_equals_windows_by_hand(spark):
    a = np.random.default_rng(1).integers(0, 256, (20, 24)).astype(np.uint8)
    xs, ys = media.cascade()._windows(a, 1)
    want = []
    for y in range(13):
        for x in range(17):
            w = a[y : y + 8, x : x + 8].astype(float)
            inner = w[1:-1, 1:-1]
            norm = np.sqrt(max(36 * (inner**2).sum() - inner.sum() ** 2, 1))
            if 2 * w[:4].sum() - w.sum() >= 0.02 * norm and 2 * w[:, :4].sum() - w.sum() < 0.01 * norm:
                want.append((x, y))
    assert sorted(zip(xs.tolist(), ys.tolist(), strict=True)) == sorted(want) and want


def test_windows(spark):
    e = windows.batch(spark, SF)
    assert windows.sliding(e).agg({"n": "sum"}).first()[0] == 4 * e.count() and windows.sessions(e).agg({"n": "sum"}).first()[0] == e.count()
