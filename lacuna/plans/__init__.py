"""The commands, composed from operators, and the catalogue of checkable queries."""
