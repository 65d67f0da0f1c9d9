"""Readers and writers of bar tables and calendars."""
