"""Continuous processing of page requests."""
