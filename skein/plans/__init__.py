"""plans of the note-graph engine."""
