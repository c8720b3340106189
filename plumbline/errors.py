"""What can go wrong for a user of the library; the command line prints these and ends with code 2."""

from __future__ import annotations


class PlumblineError(Exception):
    """Any of the errors below."""


class PathNotFound(PlumblineError, ValueError):
    """A tree, or a file of it, isn't there."""


class ImpactError(PathNotFound):
    """A module whose impact was asked for isn't among the sources."""


class ConfigError(PlumblineError, ValueError):
    """A configuration can't be read, or doesn't say what it should."""


class ReadError(PlumblineError, OSError):
    """A file can't be read or written."""
