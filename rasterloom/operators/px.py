"""Operators as plans over pixel relations: expressions, aggregates, windows and joins that Catalyst optimises.

px is (img_id, y, x, c, v); colours is (img_id, y, x, r, g, b); pairs is (img_id, y, x, c, a, b). Everything here
stays in the JVM, but for matching (vectorised blocks). Values follow the kernels' rules: clamp then truncate, or round half away, as named.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["img_id", "y", "x", "c"]


def trunc8(e: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), e)).cast("int")


def round8(e: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(e))).cast("int")


def point(px: DataFrame, e: Column) -> DataFrame:
    """A value in place of v."""
    return px.select(*KEYS, e.alias("v"))


V = F.col
POINT = {
    "apply_negative": lambda v: 255 - v,
    "bitwise_not": lambda v: 255 - v,
    "apply_log": lambda v: trunc8(F.lit(255.0 / math.log(256.0)) * F.ln(1.0 + v)),
    "apply_gamma": lambda v, gamma: trunc8(F.pow(v / F.lit(255.0), F.lit(float(gamma))) * 255.0),
    "apply_threshold": lambda v, t: F.when(v > t, 255).otherwise(0),
    "apply_threshold_binary_inv": lambda v, t: F.when(v > t, 0).otherwise(255),
    "apply_threshold_trunc": lambda v, t: F.least(v, F.lit(t)),
    "apply_threshold_tozero": lambda v, t: F.when(v > t, v).otherwise(0),
    "apply_threshold_tozero_inv": lambda v, t: F.when(v > t, 0).otherwise(v),
    "rgb_to_cmy": lambda v: F.lit(1.0).cast("float") - v.cast("float") / F.lit(255.0).cast("float"),
    "apply_pow": lambda v, p: F.pow(v.cast("double"), F.lit(float(p))),
    "apply_sqrt": lambda v: F.sqrt(v.cast("double")),
    "apply_exp": lambda v: F.exp(v.cast("double")),
    # Spark's ln is null at and below zero.
    "apply_log_op": lambda v: F.when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan"))).otherwise(F.ln(v.cast("double"))),
    "convert_scale_abs": lambda v, alpha=1.0, beta=0.0: round8(F.abs(v * F.lit(float(alpha)) + F.lit(float(beta)))),
    "apply_lut": lambda v, table: F.element_at(F.array(*[F.lit(int(t)) for t in table]), v + 1),
}


def apply_point(px: DataFrame, name: str, *params: float) -> DataFrame:
    return point(px, POINT[name](F.col("v"), *params))


PAIR = {
    "add_images": lambda a, b: F.least(a + b, F.lit(255)),
    "sub_images": lambda a, b: F.greatest(a - b, F.lit(0)),
    "add_weighted": lambda a, b, alpha, beta, gamma: trunc8(a * F.lit(float(alpha)) + b * F.lit(float(beta)) + F.lit(float(gamma))),
    "bitwise_and": lambda a, b: a.bitwiseAND(b),
    "bitwise_or": lambda a, b: a.bitwiseOR(b),
    "bitwise_xor": lambda a, b: a.bitwiseXOR(b),
    "absdiff": lambda a, b: F.abs(a - b),
    "apply_multiply": lambda a, b, s=1.0: a.cast("double") * b * F.lit(float(s)),
    "apply_divide": lambda a, b, s=1.0: F.when(F.abs(b) < 1e-9, F.lit(0.0)).otherwise(a.cast("double") / F.when(F.abs(b) < 1e-9, F.lit(1.0)).otherwise(b.cast("double")) * F.lit(float(s))),
    "apply_min": lambda a, b: F.least(a.cast("double"), b.cast("double")),
    "apply_max": lambda a, b: F.greatest(F.nanvl(a.cast("double"), b.cast("double")), F.nanvl(b.cast("double"), a.cast("double"))),
    "calculate_magnitude": lambda a, b: F.sqrt(a.cast("double") * a + b.cast("double") * b),
    "calculate_phase": lambda a, b: F.when(F.atan2(b, a) < 0, F.atan2(b, a) + 2 * math.pi).otherwise(F.atan2(b, a)),
    "polar_to_cart": lambda a, b: a * F.cos(F.radians(b.cast("double"))),
}
PAIR["cart_to_polar"] = PAIR["calculate_magnitude"]
#: Operators of two results: both, as channels 0 and 1.
TWO = {
    "cart_to_polar": (PAIR["calculate_magnitude"], PAIR["calculate_phase"]),
    "polar_to_cart": (PAIR["polar_to_cart"], lambda a, b: a * F.sin(F.radians(b.cast("double")))),
}


def pair_up(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two pixel relations side by side; shapes match or pixels are left out."""
    return a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), KEYS)


def apply_pair(pairs: DataFrame, name: str, *params: float) -> DataFrame:
    return point(pairs, PAIR[name](F.col("a"), F.col("b"), *params))


def apply_two(pairs: DataFrame, name: str) -> DataFrame:
    """Both results of an operator that gives two images, as channels 0 and 1."""
    e = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), f(F.col("a"), F.col("b")).alias("v")) for i, f in enumerate(TWO[name])]))
    return pairs.select("img_id", "y", "x", e.alias("e")).select("img_id", "y", "x", "e.c", "e.v")


def split(px: DataFrame) -> DataFrame:
    """Every channel as an image of its own: (img_id, plane, y, x, c = 0, v)."""
    return px.select("img_id", F.col("c").alias("plane"), "y", "x", F.lit(0).alias("c"), "v")


def merge(*planes: DataFrame) -> DataFrame:
    """One-channel relations as the channels of one, in the order given."""
    out = None
    for i, p in enumerate(planes):
        own = p.select("img_id", "y", "x", F.lit(i).alias("c"), "v")
        out = own if out is None else out.unionByName(own)
    return out


def colours(px: DataFrame) -> DataFrame:
    """Three channels side by side: one partial aggregate a pixel."""
    return px.groupBy("img_id", "y", "x").agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(n) for i, n in enumerate("rgb")])


def _unpivot(rgb: DataFrame, *channels: Column) -> DataFrame:
    e = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), ch.alias("v")) for i, ch in enumerate(channels)]))
    return rgb.select("img_id", "y", "x", e.alias("e")).select("img_id", "y", "x", "e.c", "e.v")


def _hue(rgb: DataFrame) -> tuple[Column, ...]:
    r, g, b = (F.col(n) / F.lit(255.0) for n in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    safe = F.when(d < 1e-10, F.lit(1.0)).otherwise(d)
    h = F.when(top == r, 60.0 * F.pmod((g - b) / safe, F.lit(6.0))).when(top == g, 60.0 * ((b - r) / safe + 2.0)).otherwise(60.0 * ((r - g) / safe + 4.0))
    return F.when(d < 1e-10, F.lit(0.0)).otherwise(h), d, top, low


def rgb_to_gray(rgb: DataFrame) -> DataFrame:
    f = lambda n, w: F.col(n).cast("float") * F.lit(w).cast("float")
    return _unpivot(rgb, trunc8((f("r", 0.299) + f("g", 0.587) + f("b", 0.114)).cast("double")))


def rgb_to_hsv(rgb: DataFrame) -> DataFrame:
    h, d, top, _ = _hue(rgb)
    s = F.when((top < 1e-10) | (d < 1e-10), F.lit(0.0)).otherwise(d / F.when(top < 1e-10, F.lit(1.0)).otherwise(top))
    return _unpivot(rgb, round8(h / 2.0), round8(s * 255.0), round8(top * 255.0))


def rgb_to_hls(rgb: DataFrame) -> DataFrame:
    h, d, top, low = _hue(rgb)
    light = (top + low) / 2.0
    room = 1.0 - F.abs(2.0 * light - 1.0)
    s = F.when(d < 1e-10, F.lit(0.0)).otherwise(F.least(d / F.when(room < 1e-10, F.lit(1.0)).otherwise(room), F.lit(1.0)))
    return _unpivot(rgb, round8(h / 2.0), round8(light * 255.0), round8(s * 255.0))


def linear(rgb: DataFrame, rows: tuple) -> DataFrame:
    return _unpivot(rgb, *[round8(F.col("r") * F.lit(a) + F.col("g") * F.lit(b) + F.col("b") * F.lit(c) + F.lit(float(o))) for a, b, c, o in rows])


YCRCB = ((0.299, 0.587, 0.114, 0), (0.5, -0.419, -0.081, 128), (-0.169, -0.331, 0.5, 128))
YUV = ((0.299, 0.587, 0.114, 0), (-0.14713, -0.28886, 0.436, 128), (0.615, -0.51499, -0.10001, 128))
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))


def _xyz() -> list[Column]:
    c = [F.when(F.col(n) / 255.0 <= 0.04045, F.col(n) / 255.0 / 12.92).otherwise(F.pow((F.col(n) / 255.0 + 0.055) / 1.055, F.lit(2.4))) for n in "rgb"]
    return [c[0] * w[0] + c[1] * w[1] + c[2] * w[2] for w in XYZ]


def rgb_to_xyz(rgb: DataFrame) -> DataFrame:
    return _unpivot(rgb, *_xyz())


def rgb_to_lab(rgb: DataFrame) -> DataFrame:
    f = [F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787037 * t + 16.0 / 116.0) for t in (x / w for x, w in zip(_xyz(), (0.95047, 1.0, 1.08883), strict=True))]
    return _unpivot(rgb, 116.0 * f[1] - 16.0, 500.0 * (f[0] - f[1]), 200.0 * (f[1] - f[2]))


def rgb_to_luv(rgb: DataFrame) -> DataFrame:
    x, y, z = _xyz()
    light = F.when(y > 0.008856, 116.0 * F.cbrt(y) - 16.0).otherwise(903.3 * y)
    d = x + 15.0 * y + 3.0 * z
    dn = 0.95047 + 15.0 + 3 * 1.08883
    part = lambda k, t: F.when(d < 1e-10, F.lit(0.0)).otherwise(k * t / F.when(d < 1e-10, F.lit(1.0)).otherwise(d))
    return _unpivot(rgb, light, 13.0 * light * (part(4.0, x) - 4 * 0.95047 / dn), 13.0 * light * (part(9.0, y) - 9.0 / dn))


def in_range(px: DataFrame, lower: list[float], upper: list[float]) -> DataFrame:
    """255 where every channel lies within its bounds."""
    lo, hi = (F.array(*[F.lit(float(x)) for x in b]) for b in (lower, upper))
    ok = (F.col("v") >= F.get(lo, F.col("c"))) & (F.col("v") <= F.get(hi, F.col("c")))
    return px.groupBy("img_id", "y", "x").agg(F.bool_and(ok).alias("ok")).select("img_id", "y", "x", F.lit(0).alias("c"), F.when(F.col("ok"), 255).otherwise(0).alias("v"))


def normalise(px: DataFrame, alpha: float = 0.0, beta: float = 255.0, norm_type: int = 32) -> DataFrame:
    """Per image: two small aggregates joined back, no window over pixels."""
    v = F.col("v").cast("double")
    s = px.groupBy("img_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sqrt(F.sum(v * v)).alias("l2"), F.sum(F.abs(v)).alias("l1"))
    at = px.join(s, "img_id")
    if norm_type == 32:
        low, high = min(alpha, beta), max(alpha, beta)
        span = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")).cast("double"))
        e = F.when(F.col("hi") == F.col("lo"), F.lit(float(low))).otherwise((v - F.col("lo")) / span * (high - low) + low)
    else:
        n = F.col("l2" if norm_type == 4 else "l1").cast("double")
        e = F.when(n > 0, v / F.when(n > 0, n).otherwise(1.0) * float(alpha)).otherwise(0.0)
    return point(at, e)


def histogram(px: DataFrame) -> DataFrame:
    return px.groupBy("img_id", "c", "v").agg(F.count("*").alias("n"))


def otsu(px: DataFrame) -> DataFrame:
    """(img_id, t): running sums over present values; absent ones never beat an earlier value."""
    h = px.groupBy("img_id", "v").agg(F.count("*").alias("n"))
    w, all_ = Window.partitionBy("img_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("img_id")
    h = h.withColumn("w", F.sum("n").over(w)).withColumn("s", F.sum(F.col("v") * F.col("n")).over(w)).withColumn("nt", F.sum("n").over(all_)).withColumn("st", F.sum(F.col("v") * F.col("n")).over(all_))
    rest = F.col("nt") - F.col("w")
    mean = F.col("s").cast("double") / F.col("w") - (F.col("st") - F.col("s")).cast("double") / F.when(rest == 0, F.lit(1)).otherwise(rest)
    h = h.withColumn("var", F.when(rest > 0, F.col("w").cast("double") * rest * mean * mean).otherwise(0.0))
    best = h.groupBy("img_id").agg(F.max(F.struct("var", -F.col("v"))).alias("m"))
    return best.select("img_id", F.when(F.col("m.var") > 0, -F.col("m.col2")).otherwise(0).alias("t"))


def apply_otsu(px: DataFrame, name: str = "apply_threshold") -> DataFrame:
    at = px.join(otsu(px), "img_id")
    return point(at, POINT[name](F.col("v"), F.col("t")))


def equalise(px: DataFrame) -> DataFrame:
    """Histogram, running sum, single-precision table, joined back per channel."""
    w, all_ = Window.partitionBy("img_id", "c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("img_id", "c")
    h = histogram(px).withColumn("cum", F.sum("n").over(w)).withColumn("tot", F.sum("n").over(all_)).withColumn("least", F.min("cum").over(all_))
    rest = F.greatest(F.col("tot") - F.col("least"), F.lit(1))
    new = F.when(F.col("tot") == F.col("least"), F.col("v")).otherwise(round8(((F.col("cum") - F.col("least")).cast("float") / rest.cast("float") * F.lit(255.0).cast("float")).cast("double")))
    return px.join(h.select("img_id", "c", "v", new.alias("o")), ["img_id", "c", "v"]).select(*KEYS, F.col("o").alias("v"))


def moments(px: DataFrame) -> DataFrame:
    v, x, y = (F.col(n).cast("bigint") for n in ("v", "x", "y"))
    orders = ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3))

    def power(e: Column, k: int) -> Column:
        out = F.lit(1).cast("bigint")
        for _ in range(k):
            out = out * e
        return out

    return px.groupBy("img_id").agg(*[F.sum(v * power(x, i) * power(y, j)).alias(f"m{i}{j}") for i, j in orders])


def min_max_loc(px: DataFrame) -> DataFrame:
    first = F.min_by(F.struct("x", "y"), F.struct("v", "y", "x"))
    last = F.min_by(F.struct("x", "y"), F.struct(-F.col("v"), F.col("y"), F.col("x")))
    s = px.groupBy("img_id").agg(F.min("v").alias("min_v"), F.max("v").alias("max_v"), first.alias("a"), last.alias("b"))
    return s.select("img_id", "min_v", "max_v", F.col("a.x").alias("min_x"), F.col("a.y").alias("min_y"), F.col("b.x").alias("max_x"), F.col("b.y").alias("max_y"))


def flip(px: DataFrame, code: int, size: tuple[int, int] | None = None) -> DataFrame:
    """size: height and width, where all images have the same; else they come from one aggregate per image, joined back."""
    if size:
        s, h, w = px, F.lit(size[0]), F.lit(size[1])
    else:
        s = px.join(px.groupBy("img_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")), "img_id")
        h, w = F.col("h"), F.col("w")
    y = h - 1 - F.col("y") if code <= 0 else F.col("y")
    x = w - 1 - F.col("x") if code != 0 else F.col("x")
    return s.select("img_id", y.alias("y"), x.alias("x"), "c", "v")


def transpose(px: DataFrame) -> DataFrame:
    return px.select("img_id", F.col("x").alias("y"), F.col("y").alias("x"), "c", "v")


def integral(px: DataFrame) -> DataFrame:
    """Two running sums; the zero row and column are left out."""
    row = Window.partitionBy("img_id", "c", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    column = Window.partitionBy("img_id", "c", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    s = px.withColumn("v", F.sum("v").over(row)).withColumn("v", F.sum("v").over(column))
    return s.select("img_id", (F.col("y") + 1).alias("y"), (F.col("x") + 1).alias("x"), "c", "v")


def hough(px: DataFrame, theta_step: int) -> DataFrame:
    """Votes of (rho, theta): a fixed table of angles joined to the edge pixels, counted with partial sums."""
    t = px.sparkSession.range(0, 180, theta_step).select(F.col("id").cast("int").alias("theta"))
    edge = px.where("v > 0").select("img_id", "x", "y")
    rho = F.round(F.col("x") * F.cos(F.radians(F.col("theta").cast("double"))) + F.col("y") * F.sin(F.radians(F.col("theta").cast("double")))).cast("int")
    # At most 180 rows: a broadcast of fixed size.
    return edge.join(F.broadcast(t)).select("img_id", rho.alias("rho"), "theta").groupBy("img_id", "rho", "theta").agg(F.count("*").alias("votes"))


# contours: pts is (contour_id, i, x, y)


def ring(pts: DataFrame) -> DataFrame:
    """Each point with its successor, the last with the first."""
    w = Window.partitionBy("contour_id").orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(c + "2")
    return pts.select("contour_id", "i", "x", "y", nxt("x"), nxt("y"), F.lead("x").over(w).isNull().alias("closing"))


def contour_measures(pts: DataFrame) -> DataFrame:
    """Area, oriented area, lengths and bounds of every contour in one pass."""
    cross = F.col("x").cast("bigint") * F.col("y2") - F.col("x2").cast("bigint") * F.col("y")
    step = F.sqrt(F.pow((F.col("x2") - F.col("x")).cast("double"), F.lit(2.0)) + F.pow((F.col("y2") - F.col("y")).cast("double"), F.lit(2.0)))
    s = ring(pts).groupBy("contour_id").agg(F.count("*").alias("n"), F.sum(cross).alias("twice"), F.sum(step).alias("closed"), F.sum(F.when(F.col("closing"), 0.0).otherwise(step)).alias("open"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return s.select("contour_id", F.when(F.col("n") < 3, F.lit(0)).otherwise(F.abs("twice")).alias("area2"), F.when(F.col("n") < 3, F.lit(0)).otherwise(F.col("twice")).alias("oriented2"), "closed", "open", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"))


# descriptors: (idx, d)


def _exact(q: np.ndarray, t: np.ndarray, norm: str) -> np.ndarray:
    """Distances of rows beside each other, summed in order of the components, as a loop would."""
    d = np.zeros(len(q))
    for a, b in zip(q.T, t.T, strict=True):
        x = a ^ b if norm == "HAMMING" else a - b
        d += np.bitwise_count(x) if norm == "HAMMING" else np.abs(x) if norm == "L1" else x * x
    return np.sqrt(d) if norm == "L2" else d


def _candidates(q: np.ndarray, t: np.ndarray, k: int, norm: str) -> tuple[np.ndarray, np.ndarray]:
    """(query, train) places of pairs among which are every query's k nearest, ties too.

    L2: squares come from one matrix product; whatever lies within the rounding error of the k-th is kept. Other norms,
    and values that aren't finite or overflow when squared, keep every pair.
    """
    if norm == "L2" and k < len(t):
        with np.errstate(over="ignore", invalid="ignore"):
            qq, tt = (q * q).sum(1), (t * t).sum(1)
            d = qq[:, None] + tt - 2 * (q @ t.T)
        if len(q) and np.isfinite(most := float(qq.max() + tt.max())) and most < 1e300:
            error = 4 * (q.shape[1] + 4) * np.finfo(float).eps * (qq[:, None] + tt.max())
            last = d.min(1) if k == 1 else np.partition(d, k - 1, 1)[:, k - 1]
            return np.nonzero(d <= last[:, None] + 2 * error)
    return np.repeat(np.arange(len(q)), len(t)), np.tile(np.arange(len(t)), len(q))


def match(query: DataFrame, train: DataFrame, k: int = 1, norm: str = "L2", block_bytes: int = 16 << 20) -> DataFrame:
    """The k nearest train rows of every query row: (query_idx, rank, train_idx, distance), ties to the smaller index.

    Queries are broadcast in blocks of at most block_bytes, cut by ranges of their index; a batch of train rows meets a
    block in NumPy and gives each query's k nearest of its own, so that k rows a query and batch are shuffled.
    Distances are summed in order of the components, as a loop would, for L2 only those near the k-th: all pairs are
    looked at still, by a matrix product.
    """
    from .images import _ship, spread

    _ship(train)
    spark = query.sparkSession
    size = query.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("d")), F.lit(0)).alias("c")).first()
    parts = max(1, -(-int(size.c) * 8 // block_bytes))
    edges = [None, None]
    if parts > 1:
        edges = [None, *sorted(set(query.select(F.percentile_approx("idx", [i / parts for i in range(1, parts)], 100 * parts)).first()[0])), None]
    found = None
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        block = query if lo is None else query.where(F.col("idx") > lo)
        block = (block if hi is None else block.where(F.col("idx") <= hi)).select(F.col("idx").cast("bigint"), F.col("d").cast("array<double>" if norm != "HAMMING" else "array<bigint>")).toArrow()
        if not block.num_rows:
            continue
        send = spark.sparkContext.broadcast((block.column(0).to_numpy(), np.array(block.column(1).to_pylist())))

        def run(batches: Iterator[pa.RecordBatch], send=send) -> Iterator[pa.RecordBatch]:
            ids, q = send.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(0).to_numpy()
                t = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                out = []
                for i in range(0, len(ids), step := max(1, (1 << 20) // len(own))):
                    at, to = _candidates(q[i : i + step], t, k, norm)
                    d = np.concatenate([_exact(q[i + at[j : j + (1 << 16)]], t[to[j : j + (1 << 16)]], norm) for j in range(0, len(at), 1 << 16)])
                    order = np.lexsort((own[to], d, at))
                    at, to, d = at[order], to[order], d[order]
                    first = np.searchsorted(at, at)
                    near = np.arange(len(at)) - first < k
                    out.append((ids[i + at[near]], own[to[near]], d[near]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_idx", "train_idx", "distance"])

        rows = spread(train.select(F.col("idx").cast("bigint").alias("idx"), F.col("d").cast("array<double>" if norm != "HAMMING" else "array<bigint>").alias("d")))
        part = rows.mapInArrow(run, "query_idx bigint, train_idx bigint, distance double")
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "query_idx bigint, train_idx bigint, distance double")
    w = Window.partitionBy("query_idx").orderBy("distance", "train_idx")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_idx", "rank", "train_idx", "distance")


def unmatched(query: DataFrame, train: DataFrame, most: float, norm: str = "L2") -> DataFrame:
    """Query rows without a train row within the distance `most`: an anti-join on the nearest one."""
    near = match(query, train, 1, norm).where(F.col("distance") <= most)
    return query.join(near.select(F.col("query_idx").alias("idx")), "idx", "left_anti")


def mutual(query: DataFrame, train: DataFrame, norm: str = "L2") -> DataFrame:
    """Cross-checked matches: each the other's nearest."""
    a = match(query, train, 1, norm)
    b = match(train, query, 1, norm).select(F.col("query_idx").alias("train_idx"), F.col("train_idx").alias("query_idx"))
    return a.join(b, ["query_idx", "train_idx"]).select("query_idx", "train_idx", "distance")
