"""Training-data operators: scoring, packing, search, near-dedup, language ID, sharding, token counts, extraction, decontamination, chat formatting."""
