"""DataFrame -> DataFrame operators, and the row expressions they share."""
