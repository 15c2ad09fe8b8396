"""Training-data operators: dedup, mixing, scoring, filtering, formatting and extraction."""
