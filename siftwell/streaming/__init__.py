"""Continuous index maintenance."""
