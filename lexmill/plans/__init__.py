"""Plan helpers: written intermediate tables and size-checked broadcasts."""
