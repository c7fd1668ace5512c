"""folioscope: document-structure indexing and retrieval on DataFrames."""

__version__ = "0.1.0"
