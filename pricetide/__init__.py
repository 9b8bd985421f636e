"""Daily price tracking on Spark: snapshots, histories, scores and catalogue queries."""
