"""Queries over the given tables and their counterparts in DuckDB SQL."""
