"""Sources as a stream, and recomputation of what an edit touches."""
