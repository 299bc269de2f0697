"""Column functions: exact money arithmetic and text parsing."""
