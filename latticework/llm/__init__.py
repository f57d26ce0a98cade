"""Training-data operators: tokens, language, quality, toxicity, dedup, search, filters, packing, mixing."""
