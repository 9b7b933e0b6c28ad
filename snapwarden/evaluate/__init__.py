"""Harnesses that score the engine on worlds with known truth."""
