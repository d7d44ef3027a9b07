"""lanternq: text retrieval, evidence and corpus tools expressed as Spark plans."""

__version__ = "0.1.0"
