"""Spark-native variant-effect analytics over genomic tables."""
