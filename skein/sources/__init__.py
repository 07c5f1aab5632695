"""sources of the note-graph engine."""
