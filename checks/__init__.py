"""Queries over the test tables, one or more per operator, and the SQL they must agree with."""
