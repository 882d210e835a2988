"""Incremental versions of the operators that allow one."""
