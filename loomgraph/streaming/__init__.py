"""Keyed state over streams of messages and observations."""
