"""Saltmarsh: retrieval, versioned key-value and workflow analytics as Spark plans."""

__version__ = "0.1.0"
