"""Readers and writers of raw events, the log, alarms, and snapshots."""
