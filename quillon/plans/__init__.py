"""Plan shapes that several operators share, and the contract's queries."""
