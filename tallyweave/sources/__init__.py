"""Readers and writers of graphs, feeds and ledger snapshots."""
