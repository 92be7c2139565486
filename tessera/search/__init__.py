"""Searching for features under budgets, with a resumable ledger."""
