"""Structured streaming over the ledger."""
