"""Comparative-effectiveness analytics on Spark DataFrames."""

from twinarm.session import cut, scratch_folder, tune

__all__ = ["cut", "scratch_folder", "tune"]
