"""Plans of lattices and their pyramids, made on the driver from a few numbers."""
