"""Operators for preparing training text: filters, near and exact copies, mixing, tokens, archives."""
