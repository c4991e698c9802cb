"""Document records on Spark: gate, split, resolve, reconcile, audit and score."""
