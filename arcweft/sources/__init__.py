"""Graphs from files and tables, and files from graphs."""
