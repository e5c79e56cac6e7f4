"""Errors that the API reports by kind."""


class BadQuery(ValueError):
    """The request or expression is wrong."""

    kind, status = "bad_data", 400


class Unsupported(BadQuery):
    """Valid, but not something this engine computes."""


class ExecutionError(RuntimeError):
    """The query is valid but its evaluation failed."""

    kind, status = "execution", 422
