"""Operators for preparing training data: filters, near copies, search, mixing and packing."""
