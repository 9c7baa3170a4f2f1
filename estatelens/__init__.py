"""Property-market analytics as plain Spark DataFrames.

``sources``    readers, column naming, typed sinks
``functions``  column expressions (missing values, rounding, dates, bands)
``operators``  DataFrame steps (de-duplication, lookups, roll-ups, changes)
``plans``      the batch pipeline, the derived views and the reports
"""
