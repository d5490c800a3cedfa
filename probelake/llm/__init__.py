"""Operators for training-data pipelines over a ``documents`` table.

Nothing outside this folder imports it; ``registry`` lists its queries.
"""
