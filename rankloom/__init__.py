"""Grouped rank tests over large sparse matrices, on Spark."""

from .api import ALL_OTHERS, CellGroup, CountMatrix, de
from .plans.spec import MeanCalc

__all__ = ["ALL_OTHERS", "CellGroup", "CountMatrix", "MeanCalc", "de", "__version__"]
__version__ = "0.1.0"
