"""Streaming jobs: the log, alarms, and derived state."""
