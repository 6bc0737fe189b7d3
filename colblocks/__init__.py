"""Adaptive block-wise columnar encoding, and the analytics around it, as Spark DataFrame plans."""
