"""Registered queries: each operator bound to the given tables, with the SQL it must agree with."""
