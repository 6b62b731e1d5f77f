"""Composite jobs: reports, stored views and the registered query catalogue."""
