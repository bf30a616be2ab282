"""Reusable plan shapes (size-checked joins, pair grids, rankings) and the query catalogue."""
