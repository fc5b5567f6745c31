"""Operators for preparing training data: each module holds one, ``queries`` registers them."""
