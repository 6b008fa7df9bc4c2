"""Operators for training-data pipelines over document tables (one module each).

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames, reads only the columns it names (extra columns, whatever their
names, never clash), and is registered over the test tables in
:mod:`rollcall.llm.registry`.
"""
