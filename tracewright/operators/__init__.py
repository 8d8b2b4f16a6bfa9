"""Operators on DataFrames: streams, templates, extraction, choice and reports."""
