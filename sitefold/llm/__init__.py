"""Operators for preparing training text: filtering, deduplication, counting, mixing and packing.

Nothing outside this subpackage imports it.
"""
