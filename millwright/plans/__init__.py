"""Operators bound to tables: controller analyses and the verification queries."""
