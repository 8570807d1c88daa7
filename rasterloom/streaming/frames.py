"""Frames as rows: (stream_id, frame_idx, ts, an image row). Consecutive pairs, background models with state, Kalman tracks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..kernels import dense, motion
from ..operators.images import _ship


def frames(images: DataFrame, streams: int = 5) -> DataFrame:
    """Images dealt to streams in turn, a second apart."""
    at = F.expr(f"img_id div {streams}")
    return images.select((F.col("img_id") % streams).alias("stream_id"), at.alias("frame_idx"), F.timestamp_seconds(F.lit(1704067200) + at).alias("ts"), "height", "width", "channels", "data")


def _image(data: bytes, h: int, w: int, c: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w, c)[..., 0]


def frame_pairs(df: DataFrame, f: Callable[[np.ndarray, np.ndarray], tuple[float, float]]) -> DataFrame:
    """Mean motion between each frame and the one before it, which `lag` brings along."""
    _ship(df)
    w = Window.partitionBy("stream_id").orderBy("frame_idx")
    pairs = df.withColumn("before", F.lag("data").over(w)).where("before is not null")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [(int(r.stream_id), int(r.frame_idx), *f(_image(r.before, r.height, r.width, r.channels), _image(r.data, r.height, r.width, r.channels))) for r in p.itertuples()]
            yield pd.DataFrame(out, columns=["stream_id", "frame_idx", "dx", "dy"])

    return pairs.mapInPandas(work, "stream_id bigint, frame_idx bigint, dx double, dy double")


def _mean(flow: np.ndarray) -> tuple[float, float]:
    return round(float(flow[..., 0].mean()), 4), round(float(flow[..., 1].mean()), 4)


def _sparse(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    p = np.array([[2.0, 2], [5, 5], [3, 4]])
    return _mean(motion.calc_optical_flow_pyr_lk(a, b, p, win_size=(5, 5), max_level=0)[0] - p[:, None])


PAIRS = {
    "calc_optical_flow_pyr_lk": _sparse,
    "SparsePyrLKOpticalFlow_create": _sparse,
    "calc_optical_flow_farneback": lambda a, b: _mean(motion.calc_optical_flow_farneback(a, b, None, 0.5, 1, 3, 2, 5, 1.1)),
    "DISOpticalFlow_create": lambda a, b: _mean(motion.DISOpticalFlow_create(0).calc(a, b)),
}


def _model(kind: str):
    return motion.BackgroundMixtures() if kind == "mog2" else motion.BackgroundNeighbours()


def batch_background(df: DataFrame, kind: str) -> DataFrame:
    """Foreground counts per frame. A stream's frames pass through one model in order, frame by frame, off sorted Arrow batches."""
    _ship(df)
    ordered = df.repartition("stream_id").sortWithinPartitions("stream_id", "frame_idx")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, model = None, None
        for p in parts:
            out = []
            for r in p.itertuples():
                if r.stream_id != now:
                    now, model = r.stream_id, _model(kind)
                mask = dense.opening(model.apply(_image(r.data, r.height, r.width, r.channels)), np.ones((1, 1)))
                out.append((int(r.stream_id), int(r.frame_idx), int((mask == 255).sum())))
            yield pd.DataFrame(out, columns=["stream_id", "frame_idx", "foreground"])

    return ordered.mapInPandas(work, "stream_id bigint, frame_idx bigint, foreground bigint")


def stream_background(df: DataFrame, kind: str = "mog2", lateness: str = "1 minute") -> DataFrame:
    """The same over an unbounded stream: the model is the group's state. Frames of a trigger are put in order; a frame
    older than the last one that was applied is dropped, and a stream whose last frame lies an hour behind the watermark loses its state."""
    _ship(df)

    def work(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pickle

        if state.hasTimedOut:
            state.remove()
            return
        last, model = (-1, _model(kind)) if not state.exists else (state.get[0], pickle.loads(state.get[1]))
        p, out = pd.concat(list(parts)).sort_values("frame_idx"), []
        for r in p.itertuples():
            if r.frame_idx > last:
                mask = model.apply(_image(r.data, r.height, r.width, r.channels))
                out.append((int(key[0]), int(r.frame_idx), int((mask == 255).sum())))
                last = int(r.frame_idx)
        state.update((last, pickle.dumps(model)))
        state.setTimeoutTimestamp(int(p["ts"].max().timestamp() * 1000) + 3_600_000)
        yield pd.DataFrame(out, columns=["stream_id", "frame_idx", "foreground"])

    return df.withWatermark("ts", lateness).groupBy("stream_id").applyInPandasWithState(work, "stream_id bigint, frame_idx bigint, foreground bigint", "last bigint, model binary", "append", GroupStateTimeout.EventTimeTimeout)


def kalman(pts: DataFrame) -> DataFrame:
    """Constant-velocity tracks through each contour's points: the last state."""
    _ship(pts)

    def one(key, p: pd.DataFrame) -> pd.DataFrame:
        k = motion.KalmanFilter(4, 2)
        k.transitionMatrix[[0, 1], [2, 3]] = 1
        k.processNoiseCov *= 0.01
        for r in p.sort_values("i").itertuples():
            k.predict()
            k.correct([r.x, r.y])
        return pd.DataFrame([(int(key[0]), *np.round(k.statePost, 4).tolist())], columns=["contour_id", "x", "y", "vx", "vy"])

    return pts.groupBy("contour_id").applyInPandas(one, "contour_id bigint, x double, y double, vx double, vy double")
