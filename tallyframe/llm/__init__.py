"""Operators for training data of language models, and their registered queries."""
