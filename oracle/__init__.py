"""DuckDB SQL that recomputes every registered query from the raw tables."""
