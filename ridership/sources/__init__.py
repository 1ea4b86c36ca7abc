"""Table schemas, readers, writers and the bindings onto the shared test tables."""
