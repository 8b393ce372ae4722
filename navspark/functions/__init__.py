"""Column-in, Column-out building blocks. No UDFs."""
