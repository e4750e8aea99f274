"""Graphs: driver-side parsing of small graphs, distributed scans of large ones."""
