"""Gridloom plans."""
