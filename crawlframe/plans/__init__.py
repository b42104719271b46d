"""Composed jobs, test views, registered queries and their check SQL."""
