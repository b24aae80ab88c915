"""pairwright: record linkage over tabular data, expressed as Spark jobs."""

__version__ = "0.1.0"
