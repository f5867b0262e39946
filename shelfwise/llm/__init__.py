"""Operators for preparing training text: mixing, filtering, near duplicates, sharding.

Nothing outside this folder imports it.
"""
