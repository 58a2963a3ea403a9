"""Staging projections, intermediate models, marts and analyses."""
