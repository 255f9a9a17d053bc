"""Structured Streaming forms of the window and story operators, for bars and articles that keep arriving."""
