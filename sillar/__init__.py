"""sillar: a Spark-first engine that builds, maintains and searches a text corpus."""

__version__ = "0.1.0"
