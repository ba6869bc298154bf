"""Spark-first analytics engine: operators, sources, functions, plans and streaming helpers."""
