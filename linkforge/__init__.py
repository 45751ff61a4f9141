"""Record linkage and near-duplicate candidate generation on Spark."""
