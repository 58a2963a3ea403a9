"""General table operators: ranking, checks, governance, profiling, charts, alerts."""
