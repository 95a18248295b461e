"""Operators for preparing language-model training data.

Nothing outside this package imports it. Every operator takes and returns
DataFrames and reads only the columns it names, so extra columns (whatever
they are called) do no harm.
"""
