"""operators of the note-graph engine."""
