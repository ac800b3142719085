"""Errors that callers may want to tell apart."""


class ModelNotFound(FileNotFoundError):
    """The model folder is missing or incomplete."""
