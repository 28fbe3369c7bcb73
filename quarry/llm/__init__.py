"""Operators for preparing language-model training data.

Nothing outside this package imports it; ``quarry.llm.catalog`` lists its
queries and their SQL twins.
"""
