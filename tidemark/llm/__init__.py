"""Corpus operators for training data: each module holds one operator."""
