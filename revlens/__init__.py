"""Review analytics on Spark: typed tables of changes, findings, packages, threads and runs."""
