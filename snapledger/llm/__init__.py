"""Operators for preparing training corpora; nothing outside this package imports it.

Every operator takes DataFrames, names its columns by parameter, and prefixes its working columns with
``__`` so that extra input columns never clash with them.
"""
