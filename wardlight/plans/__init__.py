"""Registered queries over the driver's tables, and the SQL they are checked against."""
