"""Document analytics on Spark: cleaning, parsing, chunking, retrieval and reports as DataFrame plans."""

__version__ = "0.1.0"
