"""Operators on operation logs."""
