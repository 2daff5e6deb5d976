"""Errors of the engine; each names what the caller can mend."""


class KeyloomError(Exception):
    pass


class DuplicateKeyError(KeyloomError):
    """A dataset's key does not determine its rows."""


class NodeMissingError(KeyloomError):
    pass


class NodeExistsError(KeyloomError):
    pass


class EdgeMissingError(KeyloomError):
    pass


class EdgeExistsError(KeyloomError):
    pass


class ClassExistsError(KeyloomError):
    pass


class ClassMissingError(KeyloomError):
    pass


class ClassClashError(KeyloomError):
    """Both nodes belong to different named classes."""


class TypeMismatchError(KeyloomError):
    pass


class NotANodeError(KeyloomError):
    pass


class NoPathError(KeyloomError):
    pass


class ManyPathsError(KeyloomError):
    """Several shortest paths exist; a waypoint can decide."""


class CycleError(KeyloomError):
    pass


class ColumnError(KeyloomError):
    """A column is missing, repeated, or of the wrong kind for the operation."""


class ExpressionTypeError(KeyloomError, TypeError):
    pass
