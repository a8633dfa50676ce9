"""Operators for preparing large text corpora for model training.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` derives the registered query
results from them.
"""
