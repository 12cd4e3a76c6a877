"""Keyless record linkage and its measurement, as Spark DataFrame operators."""
