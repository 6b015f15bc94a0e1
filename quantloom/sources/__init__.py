"""Vendor responses and holdings files as tables, tables as files, and merges of new rows into old ones."""
