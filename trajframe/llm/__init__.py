"""Operators for training-data pipelines over text corpora.

Nothing else in the library imports this subpackage.
"""
