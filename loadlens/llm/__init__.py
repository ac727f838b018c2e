"""Operators for preparing training data, built on the same given tables as the reports."""
