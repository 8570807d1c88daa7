"""Schemas of the data model."""

from __future__ import annotations

#: One row per pixel and channel; 8-bit values are INT, since Spark has no unsigned byte.
PX = "img_id bigint, y int, x int, c int, v int"
#: One row per image: row-major interleaved bytes.
IMAGE = "img_id bigint, height int, width int, channels int, data binary"
#: What a kernel returns that isn't an 8-bit image.
PLANES = "img_id bigint, height int, width int, channels int, v array<double>"
KEYPOINT = "struct<x: double, y: double, size: double, angle: double, response: double, octave: int, class_id: int>"
DMATCH = "struct<query_idx: int, train_idx: int, distance: double, img_idx: int>"
CONTOUR = "array<struct<x: int, y: int>>"
