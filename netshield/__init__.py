"""Access-log abuse analytics on Spark DataFrames."""

from netshield.options import Options

__all__ = ["Options"]
