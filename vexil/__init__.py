"""Vector, sparse and hybrid search over DataFrames."""

__version__ = "0.2.0"
