"""Spark-first analytics over libraries, notes, clippings and timelines."""
