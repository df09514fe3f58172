"""Operators for training data: duplicates, packing, privacy, quality, toxicity, decontamination."""
