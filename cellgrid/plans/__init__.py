"""Choices between physical plans."""
