"""The registered queries and the SQL beside them."""
