"""Operators for training-data pipelines: one module for each, with the registered queries in `queries`."""
