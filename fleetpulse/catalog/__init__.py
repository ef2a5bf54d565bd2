"""Every operator as a query over the benchmark tables, and the same question in DuckDB SQL."""
