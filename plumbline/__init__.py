"""plumbline: a PySpark engine for reality-capture data held as DataFrames."""

__version__ = "0.1.0"
