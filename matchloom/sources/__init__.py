"""Readers of board listings, URL lists, pages and fetch logs."""
