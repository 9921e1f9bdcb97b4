"""netloom: gene-network inference, scoring and ranking as Spark DataFrame operators."""
