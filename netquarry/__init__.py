"""Threat analytics over tables of network logs, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
