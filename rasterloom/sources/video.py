"""Frame containers: a .rlv file is a zip of PNG frames with their rate; a folder of images is a video as well."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np

from ..kernels import dense, motion
from . import codecs


def write_video(path: str, frames: Iterable[np.ndarray], fps: float = 20.0) -> int:
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for n, f in enumerate(frames, 1):
            z.writestr(f"{n - 1:08d}.png", codecs.encode_png(f))
        z.writestr("meta.json", json.dumps({"fps": fps, "frames": n}))
    return n


def read_video(path: str) -> Iterator[np.ndarray]:
    p = Path(path)
    if p.is_dir():
        for f in sorted(p.iterdir()):
            a = codecs.imread(f, -1)
            if a is not None:
                yield a
        return
    with zipfile.ZipFile(p) as z:
        for name in sorted(n for n in z.namelist() if n.endswith(".png")):
            yield codecs.imdecode(z.read(name), -1)


def video_capture(device_index=0, save_path=None, frames=None):
    """Runs through frames (a folder named camera<index> stands for the device) and saves them if asked."""
    shots = read_video(f"camera{device_index}") if frames is None else frames
    if save_path:
        write_video(save_path, shots)
    else:
        for _ in shots:
            pass


def extract_images_from_video(video_path, output_dir, frame_interval=1):
    Path(output_dir).mkdir(parents=True, exist_ok=True)
    kept = 0
    for i, f in enumerate(read_video(video_path)):
        if i % max(1, frame_interval) == 0:
            codecs.imwrite(f"{output_dir}/frame_{kept:05d}.png", f)
            kept += 1


def extract_video_from_images(image_paths, output_video_path, fps=20.0):
    """Paths in text order; frames of another size than the first are resized to it."""
    frames = [codecs.imread(p) for p in sorted(image_paths)]
    frames = [f for f in frames if f is not None]
    if not frames:
        raise ValueError("no image could be read")
    h, w = frames[0].shape[:2]
    write_video(output_video_path, (f if f.shape[:2] == (h, w) else dense.apply_resize(f, w, h) for f in frames), fps)


def background_subtract_mog2(video_path, history=500, var_threshold=16.0, detect_shadows=True, kernel_size=5, output_path=None):
    """Foreground masks, opened with an elliptic element; written if a path is given, else returned."""
    model, element = motion.BackgroundMixtures(history, var_threshold, detect_shadows), dense.get_structuring_element(2, kernel_size, kernel_size)
    masks = (dense.opening(model.apply(f), element) for f in read_video(video_path))
    if output_path:
        write_video(output_path, masks)
        return None
    return list(masks)
