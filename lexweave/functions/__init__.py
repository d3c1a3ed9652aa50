"""Column functions and their driver-side twins."""
