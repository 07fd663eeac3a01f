"""quillgraph: a Spark-first engine for provenance-anchored text graphs."""

__version__ = "0.1.0"
