"""Part of tagweave."""
