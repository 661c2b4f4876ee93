"""The locked settings of a study and the check that a configuration equals them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Protocol:
    """Fixed values of the primary study."""

    calendar: str = "SPY"
    window: int = 60
    decay: float = 0.94
    shrink: float = 0.1
    least_assets: int = 3
    horizon: int = 20
    loss: float = 0.10
    fill_limit: int = 5
    lag: int = 1
    calibration: int = 252
    least_known: int = 525
    budgets: tuple[float, ...] = (0.01, 0.05, 0.10)
    penalties: tuple[float, ...] = (0.01, 0.1, 1.0)
    seed: int = 42


def differences(config: Mapping[str, object], protocol: Protocol = Protocol()) -> dict[str, tuple[object, object]]:
    """name -> (locked, given) of every setting that is missing, unknown or different."""
    locked = asdict(protocol)
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    return {k: (locked.get(k), config.get(k)) for k in {*locked, *config} if k not in config or k not in locked or plain(config[k]) != locked[k]}


def require(config: Mapping[str, object], protocol: Protocol = Protocol()) -> None:
    if found := differences(config, protocol):
        raise ValueError(f"settings differ from the protocol: {found}")
