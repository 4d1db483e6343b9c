"""netstate: network-traffic time series as PySpark DataFrames."""
from netstate.config import Options

__all__ = ["Options"]
