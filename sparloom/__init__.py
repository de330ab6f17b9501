"""sparloom: analytics over text corpora, event logs and entity tables as plain Spark plans."""
