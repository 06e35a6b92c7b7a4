"""Named queries and the SQL that checks them."""
