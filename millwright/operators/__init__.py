"""Generic DataFrame operators with column-name parameters."""
