"""Composite jobs: each has a lazy builder and a ``run_*`` function that reads and writes tables."""
