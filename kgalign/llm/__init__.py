"""Training-data operations: thirteen operators, each in a module of its own.

Nothing outside this subpackage imports it. ``queries`` has the thin queries
that apply the operators to the tables, with their SQL where there is any.
"""
