"""Errors with fixed messages: they name columns and options, never cell values."""


class PlenumError(ValueError):
    """Base of all errors that a caller may show."""


class IngestError(PlenumError): ...


class RedactionError(PlenumError): ...


class ThemeError(PlenumError): ...


class AffectError(PlenumError): ...


class TimelineError(PlenumError): ...


class GapError(PlenumError): ...


class ReferenceError(PlenumError): ...  # noqa: A001


class QuestionError(PlenumError): ...


class ExportError(PlenumError): ...


class EvaluationError(PlenumError): ...
