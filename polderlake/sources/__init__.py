"""Reading, writing and upkeep of the stored tables."""
