"""tallylane: DataFrame operators for ordered, keyed, clustered event logs on Spark."""

from tallylane.keys import LogKeys

__all__ = ["LogKeys"]
