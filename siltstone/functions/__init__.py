"""Column compilers and scalar column functions."""
