"""Operators for large text corpora.  No other subpackage imports this one."""
