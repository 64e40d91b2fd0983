"""Question-and-answer corpora, their labels and table audits as Spark DataFrame jobs."""

__version__ = "0.1.0"
