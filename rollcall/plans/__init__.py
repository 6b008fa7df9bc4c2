"""Registered questions over the test tables and their SQL oracles."""
