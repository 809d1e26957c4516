"""Training-data operators: dedup, quality, tokens, extraction, filters and decontamination."""
