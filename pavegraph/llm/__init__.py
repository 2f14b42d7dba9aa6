"""Operators for building training corpora; nothing else in the library depends on this subpackage."""
