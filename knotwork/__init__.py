"""knotwork: typed graphs over tables, on Spark."""

from .graph import Graph
from .plans.pairfunctions import connector, selector
from .session import build_session

__all__ = ["Graph", "build_session", "connector", "selector"]
