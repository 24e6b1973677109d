"""Registered queries: each operator bound to the given tables, with the same result written as DuckDB SQL."""
