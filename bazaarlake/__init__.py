"""Retail market-intelligence analytics expressed as Spark DataFrame plans."""
