"""Labelled multi-dimensional data on Spark DataFrames."""

from .cube import Cube

__all__ = ["Cube"]
