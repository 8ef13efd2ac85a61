"""Curating visual question-answering benchmarks and scoring models on them, as Spark jobs."""

__version__ = "0.1.0"
