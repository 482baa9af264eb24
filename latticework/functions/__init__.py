"""Column-level functions: predicates, identities, rendering."""
