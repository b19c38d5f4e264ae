"""A query-rewriting workbench on Spark: generate, gate, verify, time and rank alternative formulations of SQL queries."""
