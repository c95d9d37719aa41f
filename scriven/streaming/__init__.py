"""Stateful and windowed operators over event streams."""
