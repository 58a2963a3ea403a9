"""Domain tables derived from the test tables."""
