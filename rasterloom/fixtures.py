"""Images, contours, boxes and descriptors derived from the tables, as DataFrames and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.images import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grey_level(e):
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((e.cast("double") + 1.0) * 127.5).cast("double"))).cast("int")


def images8(spark: SparkSession, d: str) -> DataFrame:
    """An 8x8 grey image per embedding, as image rows: no shuffle."""
    data = F.unhex(F.array_join(F.transform("embedding", lambda e: F.lpad(F.hex(_grey_level(e)), 2, "0")), ""))
    size = [F.lit(n).alias(m) for n, m in ((8, "height"), (8, "width"), (1, "channels"))]
    return spread(table(spark, d, "embeddings").select(F.col("vec_id").alias("img_id"), *size, data.alias("data")))


def img8(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("img_id"), F.posexplode("embedding").alias("i", "e"))
    return e.select("img_id", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), F.lit(0).alias("c"), _grey_level(F.col("e")).alias("v"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, v): the grey levels of an embedding's image as an array."""
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", _grey_level).alias("v"))


def _at(rows: DataFrame, e: Column) -> DataFrame:
    """(img_id, y, x, e) of rows that hold an array of structs, one a pixel of an 8x8 image."""
    at = rows.select("img_id", F.posexplode(e).alias("i", "e"))
    return at.select("img_id", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), "e")


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """(img_id, r, g, b): three embeddings' arrays side by side; an incomplete last one is left out. Whole arrays are shuffled, not pixels."""
    part = lambda k: F.max(F.when(F.col("vec_id") % 3 == k, F.col("v")))
    whole = _levels(spark, d).groupBy(F.expr("vec_id div 3").alias("img_id")).agg(F.count("*").alias("n"), *[part(k).alias(c) for k, c in enumerate("rgb")])
    return whole.where("n = 3").drop("n")


def rgb(spark: SparkSession, d: str) -> DataFrame:
    """(img_id, y, x, r, g, b)."""
    return _at(_triples(spark, d), F.arrays_zip("r", "g", "b")).select("img_id", "y", "x", "e.r", "e.g", "e.b")


def rgb8(spark: SparkSession, d: str) -> DataFrame:
    """(img_id, y, x, c, v) of the colour images."""
    e = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(c).alias("v")) for k, c in enumerate("rgb")]))
    return rgb(spark, d).select("img_id", "y", "x", e.alias("e")).select("img_id", "y", "x", "e.c", "e.v")


def rgb_images(spark: SparkSession, d: str) -> DataFrame:
    """The colour images as image rows."""
    two = lambda e: F.lpad(F.hex(e), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.arrays_zip("r", "g", "b"), lambda e: F.concat(two(e.r), two(e.g), two(e.b))), ""))
    size = [F.lit(n).alias(m) for n, m in ((8, "height"), (8, "width"), (3, "channels"))]
    return _triples(spark, d).select("img_id", *size, data.alias("data"))


def pair8(spark: SparkSession, d: str) -> DataFrame:
    """(img_id, y, x, c, a, b): two embeddings' arrays side by side. Whole arrays are joined, not pixels."""
    half = lambda k, n: _levels(spark, d).where(f"vec_id % 2 = {k}").select(F.expr("vec_id div 2").alias("img_id"), F.col("v").alias(n))
    both = half(0, "a").join(half(1, "b"), "img_id")
    return _at(both, F.arrays_zip("a", "b")).select("img_id", "y", "x", F.lit(0).alias("c"), "e.a", "e.b")


def page_images(spark: SparkSession, d: str) -> DataFrame:
    """A grey image 64 wide per page, of all its characters, as image rows; the last row is filled up with zeros, and an empty page is one row of them."""
    html = F.coalesce("html", F.lit(""))
    rows = F.greatest(F.ceil(F.length(html) / 64).cast("int"), F.lit(1))
    codes = F.transform(F.filter(F.split(html, ""), lambda ch: ch != ""), lambda ch: F.lpad(F.hex(F.ascii(ch) % 256), 2, "0"))
    data = F.unhex(F.rpad(F.array_join(codes, ""), rows * 128, F.lit("0")))
    return spread(table(spark, d, "pages")).select(F.col("page_id").alias("img_id"), rows.alias("height"), F.lit(64).alias("width"), F.lit(1).alias("channels"), data.alias("data"))


def pts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("user_id contour_id", "cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) i", "cast(day(ts) * 24 + hour(ts) as int) x", "cast(floor(value) as int) y")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_custkey img_id", "o_orderkey box_id", "cast(o_orderkey % 97 as int) x", "cast(o_orderkey % 89 as int) y", "cast(8 + o_orderkey % 31 as int) w", "cast(8 + o_orderkey % 29 as int) h", "cast(floor(o_totalprice) as bigint) % 1000 score")


SQL = {
    "img8": "SELECT vec_id AS img_id, CAST(i // 8 AS INT) y, CAST(i % 8 AS INT) x, 0 c, CAST(greatest(0, least(255, floor((CAST(e AS DOUBLE) + 1) * 127.5))) AS INT) v FROM (SELECT vec_id, unnest(embedding) e, generate_subscripts(embedding, 1) - 1 i FROM embeddings)",
    "rgb8": "SELECT img_id // 3 AS img_id, y, x, CAST(img_id % 3 AS INT) c, v FROM img8 WHERE img_id // 3 IN (SELECT vec_id // 3 FROM embeddings GROUP BY 1 HAVING count(*) = 3)",
    "rgb": "SELECT img_id, y, x, max(CASE WHEN c = 0 THEN v END) r, max(CASE WHEN c = 1 THEN v END) g, max(CASE WHEN c = 2 THEN v END) b FROM rgb8 GROUP BY 1, 2, 3",
    "pair8": "SELECT p.img_id // 2 AS img_id, p.y, p.x, p.c, p.v a, q.v b FROM img8 p JOIN img8 q ON p.img_id % 2 = 0 AND q.img_id = p.img_id + 1 AND p.y = q.y AND p.x = q.x",
    "bin8": "SELECT img_id, y, x, c, CASE WHEN v > 127 THEN 255 ELSE 0 END v FROM img8",
    "pts": "SELECT user_id contour_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) i, CAST(day(ts) * 24 + hour(ts) AS INT) x, CAST(floor(value) AS INT) y FROM events",
}


def with_fixtures(body: str, more: str = "", recursive: bool = False) -> str:
    """SQL with the fixtures as named subqueries."""
    parts = ", ".join(f"{k} AS ({v})" for k, v in SQL.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{', ' + more if more else ''} {body}"
