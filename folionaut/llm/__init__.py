"""Operators for preparing large text corpora; see the modules for each one's contract.

Nothing outside this subpackage imports it.
"""
