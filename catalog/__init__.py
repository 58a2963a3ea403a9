"""The registered queries and, where SQL can express them, the SQL they are checked against."""
