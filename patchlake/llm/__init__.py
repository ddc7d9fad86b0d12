"""Operators for preparing training data, on tables of documents and pages."""
