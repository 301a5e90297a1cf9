"""Readers and writers: driver tables, index tables, run files, parameter and query files."""
