"""Every operator as a named query on the given tables, with its SQL oracle."""
