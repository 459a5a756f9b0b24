"""Operators for large training-data pipelines: filters, classifiers, joins, tokenisation, decontamination."""
