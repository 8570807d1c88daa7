"""rasterloom: image analytics on Spark DataFrames, one row per image, frame, contour or descriptor set."""

__version__ = "0.1.0"
