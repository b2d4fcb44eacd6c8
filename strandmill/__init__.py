"""strandmill: a Spark-first engine for sequence-mining tables and campaign logs."""

__version__ = "0.1.0"
