"""loomgraph: source-code graph analytics and large-table processing on Spark DataFrames."""

__version__ = "0.1.0"
