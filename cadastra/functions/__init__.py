"""Column functions and numpy geometry."""
