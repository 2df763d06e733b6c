"""Spark-first verification engine for machine-read business documents."""
