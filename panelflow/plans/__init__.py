"""Compositions: test panels, the staged run and the query catalogue."""
