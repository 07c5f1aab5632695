"""functions of the note-graph engine."""
