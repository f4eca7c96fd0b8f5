"""Training-data operators: each module is one operator with its own general interface.

Nothing outside this subpackage imports it. ``queries.py`` holds the thin ``opN_<name>``
queries over the standard tables, ``oracles.py`` their SQL.
"""
