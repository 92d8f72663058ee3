"""Operators for training-data pipelines over documents and vectors.

Nothing outside this package imports it.  Every operator takes the columns it names from its input,
ignores the others, and states in its docstring what nulls, empty texts, ties and repeated rows give.
"""
