"""Spark-native analytics for biological sequences and peptide lists."""

__version__ = "0.1.0"
