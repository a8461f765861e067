"""Skein: code-graph, retrieval, audit and metric operators as Spark DataFrame transformations."""
