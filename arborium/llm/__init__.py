"""Operators for training-data pipelines over tables of documents and pages.

Nothing else in the library imports this subpackage.
"""
