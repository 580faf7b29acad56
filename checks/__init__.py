"""Registered queries over the given tables, with DuckDB SQL to check them."""
