"""How the given tables project onto the ledger, and the registered queries."""
