"""Choices where documents and long-standing behaviour differ; the defaults are the behaviour."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Semantics:
    #: Foreign tickers at adjusted prices too.
    adjust_all: bool = False
    #: An edge is given even where a trade has too few controls.
    edge_without_controls: bool = True
    entry_mode: str = "next_open"
    #: Sessions around events that are no controls; None is the event's cooldown.
    exclusion: int | None = None
    #: The window before an event is widened by the horizon as well.
    widen_exclusion: bool = False
    #: The decision counts trades of all horizons.
    count_horizons_in_n: bool = True
    min_coverage_pct: float = 50.0
    #: Sessions that an exchange rate is carried.
    fx_carry: int = 5
    embargo_sessions: int = 0
