"""Training-data operators: corpus stages that work on the documents tables.

Nothing outside this subpackage imports it.
"""
