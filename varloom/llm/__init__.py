"""Operators for preparing training text at scale. Nothing else in varloom imports this subpackage."""
