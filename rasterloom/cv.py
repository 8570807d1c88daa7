"""The operators on arrays, by their public names and signatures: `from rasterloom import cv; cv.apply_blur(a, 3, 3)`."""

from .registry import KERNELS

globals().update(KERNELS)
__all__ = sorted(KERNELS)
