"""Readers: the driver's tables as a context graph, and transcripts as lines of JSON."""
