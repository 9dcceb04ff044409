"""Operators that prepare page texts as training data: filters, deduplication, decontamination, archives, packing."""
