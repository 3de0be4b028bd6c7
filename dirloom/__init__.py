"""Directory analytics on Spark: schema-governed attribute/value records as DataFrames."""

__version__ = "0.1.0"
