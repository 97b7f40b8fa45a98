"""seedquorum: how reproducible clusterings and method benchmarks are under random seeds, as Spark plans."""
