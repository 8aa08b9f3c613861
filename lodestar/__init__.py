"""Spark analytics over linked, semi-structured documents."""
