"""eventfold: event-sourced work data as Spark jobs.

Append-only change events in, current state, audits and index queries out.
Everything is a ``DataFrame -> DataFrame`` function; see README.md for a tour.
"""

__version__ = "0.1.0"
