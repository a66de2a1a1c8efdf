"""Column functions: everything here compiles to built-in Spark expressions."""
