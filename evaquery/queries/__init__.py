"""Queries over the driver's tables, by the operator inventory's ids."""
