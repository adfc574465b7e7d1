"""Streaming forms of the operators that can run on endless input."""
