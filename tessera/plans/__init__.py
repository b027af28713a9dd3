"""Scans as plain data, and their compilation to DataFrames."""

from .planner import scan
from .spec import CellInterval, RowInterval, ScanBuilder, ScanSpec, cells_where, rows_where, times_where

__all__ = ["CellInterval", "RowInterval", "ScanBuilder", "ScanSpec", "cells_where", "rows_where", "scan", "times_where"]
