"""Training-data operators: extraction, deduplication, language, packing, decontamination."""
