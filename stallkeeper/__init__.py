"""Retail-marketplace and message-access analytics as PySpark DataFrame operators."""
