"""Registered queries: each a function of (spark, table directory) with the equivalent DuckDB SQL."""
