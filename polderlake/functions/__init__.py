"""Column builders: plain functions that return a Column and add no shuffle."""
