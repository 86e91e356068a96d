"""Tables, the append-only log, snapshots and file readers."""
