"""streaming of the note-graph engine."""
