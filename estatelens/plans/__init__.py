"""The batch pipeline, the derived views and the reports.

Reports take view DataFrames and keyword parameters and return DataFrames.
The figures of one screen that share a filter are the columns of one row, so
that they cost one pass over the table.
"""
