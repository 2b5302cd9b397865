"""Reconciliation of bank statements and ledgers, and corpus preparation, as Spark jobs."""
