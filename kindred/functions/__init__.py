"""Functions of the record-linkage engine."""
