"""The page of a profile."""
