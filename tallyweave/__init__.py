"""Evidence-ledger analytics and training-data jobs on Spark."""
