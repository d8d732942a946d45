"""What can be wrong with an input or a configuration. All are :class:`GateError`; the command line exits with 3."""

from __future__ import annotations


class GateError(ValueError):
    """``kind`` names the sort of error; ``line`` is the 1-based input line where there is one."""

    def __init__(self, kind: str, message: str, line: int | None = None):
        super().__init__(f"line {line}: {message}" if line is not None else message)
        self.kind, self.line = kind, line


# The kinds of errors.
KINDS = (
    "InvalidJson", "InvalidCsv", "SchemaMismatch", "DuplicateId", "EmptyInput", "InvalidConfidence", "InvalidThreshold",
    "IncompatibleCiMethod", "IncompatibleFailurePolicy", "IncompatibleBootstrapMethod", "InvalidQuantile",
    "QuantileRequiresQuantileDiffMetric", "UnsupportedPowerMetric", "PowerUnsupportedForQuantileDiff", "PowerRequiresEffectGap",
    "InvalidTargetPower", "PowerSearchExceededCap", "InvalidAssumeSd", "InsufficientPilotData", "ZeroVariancePilotData",
    "MeanDiffPowerRequiresSd", "AssumeSdOnlyForMeanDiff", "InvalidValue", "UnrecognizedStatus", "UnrecognizedOutcome", "Io",
    "IncompatibleClusterById", "ClusterByIdConflictsWithPairedById", "CorrectionConflictsWithClusterById",
    "CorrectionRequiresClosedFormCi", "BradleyTerryDidNotConverge",
)


def fail(kind: str, message: str, line: int | None = None) -> None:
    assert kind in KINDS
    raise GateError(kind, message, line)
