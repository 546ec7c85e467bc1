"""Errors of the engine."""


class SiftwellError(Exception):
    """Base of all errors that the engine raises on purpose."""


class ConfigError(SiftwellError):
    """Configuration is missing or malformed."""


class VectorStoreError(SiftwellError):
    """Vectors cannot be read, written or searched."""


class MetadataError(SiftwellError):
    """Project or file metadata is missing or inconsistent."""


class IndexerError(SiftwellError):
    """An index run cannot go on."""
