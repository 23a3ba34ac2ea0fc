"""The engine's queries over the driver's tables, each beside its DuckDB SQL."""
