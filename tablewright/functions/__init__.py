"""Column-level helpers: everything here returns built-in Spark expressions."""
