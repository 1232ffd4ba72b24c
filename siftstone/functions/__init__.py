"""Column functions; nothing here reads or shuffles."""
