"""Training-data operators: dedup, filters, classifiers, search, tokenizing and mixing.

Nothing else in the library imports this subpackage.
"""
