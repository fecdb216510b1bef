"""Operators a training-data pipeline needs besides the corpus, packing and chat work of the library.

Nothing outside this folder imports it.
"""
