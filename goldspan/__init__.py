"""goldspan: entity resolution and governed golden records, expressed as Spark plans."""

__version__ = "0.1.0"
