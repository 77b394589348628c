"""Events on flanks, by hand."""

import numpy as np

from pulsegrid.operators import events as E


def by_hand(events, x, limit, ceiling, before, after):
    low = [i for i, v in enumerate(x) if v <= -limit]
    runs = []
    for i in low:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    out = set()
    for a, z in runs:
        if any(v >= ceiling for v in x[max(0, a - 2 * before) : z + 2 * after]):
            continue
        start, stop = a - before, z + after
        minima = [i for i in range(max(1, start + 1), min(len(x) - 1, stop)) if x[i] < x[i - 1] and x[i] < x[i + 1]]
        own = [e for e in events if start <= e <= stop]
        if not minima:
            continue
        of = {e: min(minima, key=lambda m: (abs(m - e), m)) for e in own}
        for m in set(of.values()):
            group = sorted((e for e in own if of[e] == m), key=lambda e: (abs(e - m), e))
            out |= {e for e in group[1:] if stop - e > after / 10 and e - start > before / 10}
    return out


def test_flank_events(spark):
    rng = np.random.default_rng(4)
    x = {r: np.convolve(rng.normal(size=1500), np.ones(5) / 2, "same").round(3) for r in ("a", "b")}
    for v in x.values():
        v[300:340] = -6 + np.abs(np.arange(40) - 20) / 8
        v[800] = 9.0
    events = {r: sorted(rng.choice(1500, 300, replace=False).tolist()) for r in x}
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds).repartition(3)
    samples = frame([(r, i, float(v)) for r, own in x.items() for i, v in enumerate(own)], "rec_id string, t long, v double")
    found = frame([(r, t) for r, own in events.items() for t in own], "rec_id string, t long")
    got = {(r.rec_id, r.t) for r in E.flank_events(found, samples, samples, 2.0, 5.0, 6, 9, 1, 100).collect()}
    want = {(r, t) for r in x for t in by_hand(events[r], x[r], 2.0, 5.0, 6, 9)}
    assert len(want) > 20 and got == want
