"""Registered queries over the driver's tables, beside their SQL."""
