"""Operators of a large-scale training-data pipeline.

One module per operator; ``queries`` registers one query per operator and
its DuckDB SQL where SQL can express it. Nothing else in the library imports
this subpackage.
"""
