"""Registered queries: an operator applied to tables derived from the given ones, with the SQL that checks it."""
