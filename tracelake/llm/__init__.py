"""Operators for large training-data corpora; nothing outside this subpackage imports it.

Executors must be able to import ``tracelake`` (``--py-files`` or an installed wheel).
"""
