"""What cells are read from and written to."""
