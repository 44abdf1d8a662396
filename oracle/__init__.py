"""Reference results as DuckDB SQL over the given tables, one statement per query."""
