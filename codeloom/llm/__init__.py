"""Operators that prepare a training corpus of code and text.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when the package is there.
"""
