"""Graph operators over streams."""

from .operators import stream_band_edges, stream_once, stream_partition
from .sessions import stream_clusters

__all__ = ["stream_band_edges", "stream_clusters", "stream_once", "stream_partition"]
