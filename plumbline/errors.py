"""Errors of the public API."""


class PlumblineError(Exception):
    """Any failure that the library reports on purpose."""


class UnsupportedDataError(PlumblineError, TypeError):
    """A source that no reader takes."""


class ConfigurationError(PlumblineError, ValueError):
    """An option that doesn't exist or has no such value."""
