"""Jobs over the ledger: each takes DataFrames and returns DataFrames."""
