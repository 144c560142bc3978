"""Queries of the driver contract with their SQL oracles."""
