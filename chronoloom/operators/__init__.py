"""DataFrame operators over series records."""
