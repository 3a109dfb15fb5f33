"""Operators of a training-data pipeline: packing, language-model scores, mixing,
near and exact duplicates, toxicity, site boilerplate, chat formatting, token counts.

Nothing else in the library imports this package.
"""
