"""Column expressions: time parsing, geometry on the sphere, key packing."""
