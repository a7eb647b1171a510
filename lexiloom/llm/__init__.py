"""Operators that prepare texts and captions as training data."""
