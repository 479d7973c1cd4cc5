"""Operators for preparing large text corpora.

Ten operators, one module each. Every one takes DataFrames, never collects the corpus, and returns
the id with its own columns only, so extra or clashing columns of the input cannot collide.
``queries`` registers them.
"""
