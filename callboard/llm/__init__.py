"""Operators that a training-data pipeline needs: near and exact duplicate removal, secret and
toxicity scans, quality rules, language identification, language-model scoring, benchmark
decontamination, source mixing and sharding.

Nothing outside this folder imports it.
"""
