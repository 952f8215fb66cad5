"""Operators for preparing training text, images of text and conversations at scale."""
