"""Column expressions: codecs, addressing, hydraulics."""
