"""Reading, writing and merging bar tables."""
