"""The queries registered in ``__spark_entry__`` and the SQL that checks them."""
