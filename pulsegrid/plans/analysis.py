"""From event trains to classified bursts and diagnostics, for all recordings in one job."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

from pulsegrid.functions import SECOND
from pulsegrid.operators import bursts as B
from pulsegrid.operators import events as E
from pulsegrid.operators import intervals as I
from pulsegrid.operators import maps as M


@dataclass(frozen=True)
class Params:
    """Times in microseconds; unknown names are rejected by of()."""

    max_gap: int = 2_500_000
    merge_limit: int = 3_500_000
    dead_time: int = 83_333
    offset: int = 600 * SECOND
    stretch_margin: int = 3 * SECOND
    point_margin: int = 2 * SECOND
    mask_distance: int = 100 * SECOND
    least_events: int = 5

    @classmethod
    def of(cls, **values: int) -> Params:
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return cls(**values)


def analyse(events: DataFrame, bounds: DataFrame, stretches: DataFrame, points: DataFrame, codebook: DataFrame, variables: list[dict], params: Params | None = None) -> dict[str, DataFrame]:
    """masks, events (thinned and clean), bursts (features, bmu, rank, si) and diagnostics of events (rec_id, t) within bounds (rec_id, lo, hi)."""
    p = params or Params()
    masks = I.fuse_masks(stretches, points, p.stretch_margin, p.point_margin, p.mask_distance)
    clean = I.clean_events(E.refractory(events, p.dead_time), masks)
    found = E.bursts(clean, p.max_gap, p.merge_limit)
    classed = B.classify(B.burst_features(clean, found), codebook, variables, p.least_events)
    return {"masks": masks, "events": clean, "bursts": classed, "diagnostics": M.diagnostics(clean, found, I.analyzed_duration(bounds, masks, p.offset))}
