"""Research analytics on Spark: dated documents and market bars to auditable signals, and corpora to training data."""
