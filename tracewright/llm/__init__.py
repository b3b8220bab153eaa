"""Operators on texts and tokens; nothing else in the library imports this subpackage."""
