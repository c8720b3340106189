"""Architecture analytics over relational encodings of source code, on Spark."""

__version__ = "0.1.0"
