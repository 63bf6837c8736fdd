"""Column functions: text clean-up, clamping, key-stable random numbers."""
