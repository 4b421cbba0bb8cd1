class ScorecastError(Exception):
    """Base of the errors raised by this package."""


class EmptySourceError(ScorecastError):
    """A source that must hold rows holds none."""


class DuplicateKeyError(ScorecastError):
    """A table has more than one row for a key that must be unique."""


class UnmappedTeamError(ScorecastError):
    """Teams of one table are absent from another."""


class NoSharedFolderError(ScorecastError):
    """A cluster session names no shared folder in spark.checkpoint.dir."""
