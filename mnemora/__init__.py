"""Mnemora: search, click analytics and data preparation over a saved web history, on Spark."""

__version__ = "0.1.0"
