"""Training-data operators: each module holds one DataFrame operator, ``queries`` registers them.

Nothing outside this subpackage imports it.
"""
