"""Operators for preparing training text: one module per operator, their
registered queries in ``queries``. Nothing else in the library imports this
subpackage."""
