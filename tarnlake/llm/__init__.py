"""Training-data operators: dedup, scoring, tokens, packing, search, privacy, decontamination."""
