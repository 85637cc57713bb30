"""Column functions: everything here takes and returns Columns and stays inside the JVM."""
