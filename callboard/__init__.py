"""Spark-first analytics over catalogues of support opportunities."""
