"""The registered queries and whole jobs."""
