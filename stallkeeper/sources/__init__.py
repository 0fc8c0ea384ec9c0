"""Readers, writers and the mapping of the test tables to the data model."""
