"""Readers and writers: landed polls, message feeds, stored tables."""
