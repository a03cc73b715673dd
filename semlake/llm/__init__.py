"""Operators for preparing large text collections for language-model training.

Nothing else in the library imports this subpackage; ``registry`` lists its queries.
"""
