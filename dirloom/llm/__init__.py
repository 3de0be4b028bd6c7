"""Operators for training data: copies, packing, leaked passages, kinds of text. Nothing else in the library imports them."""
