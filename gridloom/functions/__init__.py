"""Gridloom functions."""
