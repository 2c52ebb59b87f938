"""Number rules and expression compilers."""
