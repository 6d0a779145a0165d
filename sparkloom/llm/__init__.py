"""Operators for preparing language-model training text.

Nothing else in the library imports this subpackage.  ``queries`` holds the
registered queries and their SQL twins; every other module is one operator.
"""
