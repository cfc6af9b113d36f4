"""DataFrame operators over the event table."""
