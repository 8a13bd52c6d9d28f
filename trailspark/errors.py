"""Errors callers can tell apart."""


class TrailError(ValueError):
    """Base of all errors raised for what a caller passed."""


class SchemaError(TrailError):
    pass


class ParameterError(TrailError):
    pass


class UnknownNameError(TrailError):
    pass


class PatternError(TrailError):
    pass


class EmptyResultError(TrailError):
    pass
