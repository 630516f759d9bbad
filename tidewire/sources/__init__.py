"""Readers and writers of landed tables, archives and page collections."""
