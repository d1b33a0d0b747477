"""Registered queries: every operator applied to whole input tables, with its SQL statement."""
