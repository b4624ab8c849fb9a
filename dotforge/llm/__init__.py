"""Training-data operators: filtering, near-duplicate search, scoring, mixing, archives."""
