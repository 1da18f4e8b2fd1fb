"""Distributed operators that Spark does not ship."""
