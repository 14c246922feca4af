"""Operators for preparing training corpora: archives, dedup, mixing, packing, scoring.

Nothing else in the library imports this subpackage.
"""
