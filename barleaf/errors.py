"""The errors of each stage."""


class StageError(ValueError):
    """What a command turns into exit code 1."""


class IngestError(StageError):
    pass


class SchemaError(IngestError):
    pass


class FrozenDatasetError(IngestError):
    pass


class ValidationError(StageError):
    def __init__(self, failures: list):
        self.failures = failures
        super().__init__("; ".join(f"{f['name']}: {f['message']}" for f in failures))


class SecurityMasterError(StageError):
    pass


class UniverseError(StageError):
    pass


class AdjustError(StageError):
    pass


class LabelError(StageError):
    pass


class FeatureError(StageError):
    pass


class LoaderError(StageError):
    pass


class FoldError(StageError):
    pass


class LockedTestError(RuntimeError):
    """Locked data was asked for without a token."""


class LeakageError(AssertionError):
    """A fold, panel or pipeline breaks a rule of time safety."""
