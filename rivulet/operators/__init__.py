"""The graph operators, as functions of relations and by name in the registry."""
