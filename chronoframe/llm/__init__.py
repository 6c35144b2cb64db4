"""Operators of a training-data pipeline: licences, tokens, urls, mixing, quality,
near-duplicates, toxicity, HTML and exact search.

Nothing outside this subpackage imports it. Operators take DataFrames and name
the columns they need; other columns are ignored, whatever their names.
"""
