"""All registered queries of the library, apart from those of the subpackage for training data."""

from . import flows, grid, hexes, rasters, shapes, tabular
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flows", "grid", "hexes", "rasters", "shapes", "tabular"]
