"""Null distributions and scalar formulas."""
