"""Readers, calendars, writers and the panels of the test data."""
