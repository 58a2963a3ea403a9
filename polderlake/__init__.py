"""Governed lakehouse operators written as Spark DataFrame code."""
