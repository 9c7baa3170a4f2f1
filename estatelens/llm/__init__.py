"""Operators of a training-data pipeline. Nothing else in the library imports this package.

``queries`` registers one query for each operator; every operator can be used on its own.
"""
