"""Operators over texts. Nothing outside this subpackage imports it."""
