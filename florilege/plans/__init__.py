"""Named queries: operators applied to the tables, with the SQL that checks them."""
