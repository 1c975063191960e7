"""Operators over DataFrames of logs, ledgers, notes and code graphs."""
