"""The registered queries and the SQL their results are checked against."""
