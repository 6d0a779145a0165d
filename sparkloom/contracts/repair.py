"""Diagnose a result by contracts, and repair it by the operator library until its own contract is silent."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sparkloom.compare import equal, subset_equal
from sparkloom.contracts.engine import CONTRACTS, run_all, verdict
from sparkloom.operators.transforms import OPERATORS
from sparkloom.params import Inputs, Params

Backend = Callable[[str, Inputs, Params, int], DataFrame | None]


@dataclass(frozen=True)
class Diagnosis:
    fired: tuple[str, ...]
    primary: str | None
    abstained: bool = False


def diagnose(inputs: Inputs, params_of: Mapping[str, Params], result: DataFrame | None, hint: str | None = None) -> Diagnosis:
    """All contracts that fire (pruned to the result's family); the hinted one is primary if it did."""
    if result is None:
        return Diagnosis((), None, True)
    fired = tuple(n for n, f in run_all(inputs, dict(params_of), result).items() if f)
    return Diagnosis(fired, hint if hint in fired else next(iter(fired), None))


def library_backend(name: str, inputs: Inputs, params: Params, attempt: int) -> DataFrame | None:
    """The right transform of the operator."""
    return OPERATORS[name](inputs, params)


def repair(name: str, inputs: Inputs, params: Params, result: DataFrame | None, budget: int = 3, backend: Backend = library_backend) -> tuple[str, DataFrame | None, int]:
    """Outcome, last result, attempts: no_error, contract_pass, budget, malformed or abstained."""
    if name not in CONTRACTS:
        return "abstained", result, 0
    first = verdict(name, inputs, params, result).first()
    if not first.applicable:
        return "abstained", result, 0
    if not first.fired:
        return "no_error", result, 0
    for attempt in range(1, budget + 1):
        new = backend(name, inputs, params, attempt)
        if new is None:
            return "malformed", result, attempt
        result = new
        if not verdict(name, inputs, params, result).first().fired:
            return "contract_pass", result, attempt
    return "budget", result, budget


def run_arm(arm: str, name: str, inputs: Inputs, params: Params, result: DataFrame, gold: DataFrame, budget: int = 3, backend: Backend = library_backend) -> tuple[bool, int]:
    """One arm of a comparison: stop when the result no longer changes, its contract is silent, or it equals gold.

    Whether the last result equals gold, and the attempts used.
    """
    for attempt in range(1, budget + 1):
        if arm == "contract" and not verdict(name, inputs, params, result).first().fired or arm == "gold" and subset_equal(result, gold):
            return subset_equal(result, gold), attempt - 1
        new = backend(name, inputs, params, attempt)
        if new is None or arm == "fixpoint" and equal(new, result):
            return subset_equal(result, gold), attempt
        result = new
    return subset_equal(result, gold), budget
