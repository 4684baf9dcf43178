"""Errors raised by the input checks."""


class PanelError(ValueError):
    """The panel does not satisfy a precondition of the analysis."""
