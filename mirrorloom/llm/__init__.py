"""Operators of a training-data pipeline: one module for each, queries in ``queries``."""
