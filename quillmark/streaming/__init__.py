"""Snapshots carried from micro-batch to micro-batch."""
