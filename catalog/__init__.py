"""The registered queries, their change batches and the SQL they are checked against."""
