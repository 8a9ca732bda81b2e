"""Leakage-aware dataset analytics on Spark: lazy DataFrame -> DataFrame operators."""
