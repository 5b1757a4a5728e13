"""Skriptor: corpus analytics on Spark DataFrames.

Every operator takes a DataFrame and parameters and returns a lazy DataFrame;
sources are never modified.
"""

__version__ = "0.1.0"
