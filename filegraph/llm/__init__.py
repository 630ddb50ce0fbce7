"""Training-data operators (personal data, near duplicates, quality, mixing, tokens).

Self-contained: nothing else in the library imports this subpackage.
"""
