"""Where tables come from and where jobs keep their intermediate tables."""
