"""Streams against a fixed search side; beyond what batch operators offer."""
