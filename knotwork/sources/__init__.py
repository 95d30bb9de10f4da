"""Reading and writing node and edge tables."""

from .readers import read_netcdf, read_npy, read_pajek, read_table
from .store import TableStore

__all__ = ["TableStore", "read_netcdf", "read_npy", "read_pajek", "read_table"]
