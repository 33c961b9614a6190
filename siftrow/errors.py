"""The one exception type raised by guards.

A guard runs before any work is planned: a wrong header, an unreadable ledger,
a missing folder. Trouble with a single document is never an exception; it is a
row with a ``stage`` and a ``reason``.
"""


class GuardError(Exception):
    """A run-level precondition does not hold."""
