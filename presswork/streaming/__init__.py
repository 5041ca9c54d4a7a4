"""Reports over readings that keep arriving."""
