"""Queries over the proxy panel, each with DuckDB SQL for the same rows."""
