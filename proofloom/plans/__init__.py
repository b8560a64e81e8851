"""Reusable plan shapes: chunked scans, nearest-neighbour tiles, fixpoint loops."""
