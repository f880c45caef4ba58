"""Fact tables from source files."""
