"""Gridloom operators."""
