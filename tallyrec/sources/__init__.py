"""Reading and writing the domain tables."""
