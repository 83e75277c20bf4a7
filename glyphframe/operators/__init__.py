"""Grouped and relational operators over pages, regions and lines."""
