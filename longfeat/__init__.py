"""Longitudinal event features on Spark: lazy ``DataFrame -> DataFrame`` operators."""
