"""Training-data operators: tokenising, filtering, deduplicating, mixing, archiving, formatting."""
