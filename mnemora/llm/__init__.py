"""Preparation of training data from the archive: nine operators, their queries and their SQL.

Nothing outside this package imports it; ``registry`` holds the queries."""
