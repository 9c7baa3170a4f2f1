"""Registered queries: the library on the driver's tables, each with SQL for comparison."""
