"""Tidemark: dated-text and volatility analytics as Spark plans."""
