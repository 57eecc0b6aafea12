"""Tarnweave: a PySpark engine that builds, ranks and searches a web index."""
