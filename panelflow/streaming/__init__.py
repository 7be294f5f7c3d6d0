"""Structured Streaming versions of the operators that have one."""
