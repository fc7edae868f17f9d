"""Operators for preparing training text: tokenising, sharding, de-duplication, filtering, scanning and fixity.

Nothing else in the library imports this subpackage.  ``registry`` holds the queries.
"""
