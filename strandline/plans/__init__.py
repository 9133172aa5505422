"""Queries over the bench tables; each module has QUERIES and, where SQL states the result, ORACLES."""
