"""DataFrame operators: name resolution, address and crossing lookup, search."""
