"""Readers and writers of interchange formats.

Files are listed and read by Spark (binaryFile or text), so any store that Spark reads will do; a parser turns the
bytes of one file into rows inside a task.
"""
