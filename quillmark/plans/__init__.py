"""The whole runs: full, delta and chat bundles."""
