"""Column functions: identities, text, subject matching, arithmetic."""
