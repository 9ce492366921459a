"""Parameters and inputs checked before a job: every change of a value comes with its reason."""

from __future__ import annotations


def clamped(value: int | None, least: int, most: int, default: int, what: str) -> tuple[int, str | None]:
    """(value, reason): the value inside its bounds; the reason is None where nothing was changed."""
    if value is None:
        return default, f"{what} wasn't given: {default} is used"
    if value < least:
        return least, f"{what} {value} is too small: {least} is used"
    if value > most:
        return most, f"{what} {value} is too large: {most} is used"
    return value, None


def useful_workers(asked: int, length: int, least_each: int = 4 << 20, cores: int = 1) -> tuple[int, str | None]:
    """(workers, reason): not more than the cores, and each with enough to do."""
    most = max(1, min(cores, length // least_each))
    if asked > most:
        return most, f"{asked} workers are too many for {length} symbols on {cores} cores: {most} are used"
    return clamped(asked, 1, most, most, "number of workers")


def pair_warnings(length_a: int, length_b: int) -> list[str]:
    """What a user should know before two sequences are compared; zero symbols are an error."""
    if not length_a or not length_b:
        raise ValueError("a sequence without symbols can't be compared")
    if length_a == length_b:
        return []
    return [f"lengths differ by {abs(length_a - length_b)}: only the first {min(length_a, length_b)} symbols are compared"]
