"""Tables: versioned storage, constraints, changes."""
