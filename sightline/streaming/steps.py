"""Steps of the history lanes for streams: one row in, bounded state on, the rows of the batch windows out."""

from __future__ import annotations

from collections.abc import Callable
from statistics import median

from sightline.operators.history import HORIZONS, MAX_EVENTS, RECON, RECON_TTL

RECURRENCE_OUT = (
    "obs_id string, us long, event_count int, result_type string, missing_events int, span_us long, interval_count int, median_us double, mad_us double, "
    "state_version int, support array<string>"
)


def recon_out(lane: str) -> str:
    counts = ", ".join(f"distinct_{n} int" for n in RECON[lane][1])
    return f"obs_id string, us long, horizon_s int, attempts int, {counts}, retained int, dropped long, truncated boolean, quality_states string, lower_bound boolean"


def recon_step(lane: str, horizons: tuple[int, ...] = HORIZONS, cap: int = MAX_EVENTS, ttl_s: int = RECON_TTL) -> Callable:
    """State: the session's last `cap` events, its last time, and how many events the cap has pushed out of the horizon."""
    counted, longest = RECON[lane][1], max(horizons) * 1_000_000

    def step(s: dict | None, r: dict) -> tuple[dict, list[tuple]]:
        us = r["us"]
        if s is None or us - s["last"] >= ttl_s * 1_000_000:
            s = {"events": [], "last": us, "dropped": 0}
        events, dropped = s["events"], s["dropped"]
        dropped += len(events) == cap and events[0]["us"] >= us - longest
        events = [*events, {c: r.get(c) for c in ("us", "target", "dport", "quality")}][-cap:]
        kept = [e for e in events if e["us"] >= us - longest]
        quality = sorted({e["quality"] for e in kept if e["quality"] is not None})
        out = []
        for h in horizons:
            inside = [e for e in kept if e["us"] >= us - h * 1_000_000]
            distinct = [len({tuple(e[c] for c in names) for e in inside}) for names in counted.values()]
            out.append((r["obs_id"], us, h, len(inside), *distinct, len(kept), dropped, dropped > 0, ",".join(quality), "DEGRADED" in quality))
        return {"events": events, "last": us, "dropped": dropped}, out

    return step


def recurrence_step(ttl_us: int, cap: int = 32, least: int = 3) -> Callable:
    """State: the session's last `cap` starts and ids, and how many it has had."""

    def step(s: dict | None, r: dict) -> tuple[dict, list[tuple]]:
        us, me = r["us"], r["obs_id"]
        if s is None or us - s["times"][-1] >= ttl_us:
            s = {"times": [], "ids": [], "version": 0}
        times, ids, version = [*s["times"], us][-cap:], [*s["ids"], me][-cap:], s["version"] + 1
        n, enough = len(times), len(times) >= least
        gaps = [b - a for a, b in zip(times, times[1:])]
        mid = float(median(gaps)) if enough else None
        row = (
            me, us, n, "REVIEW_FINDING" if enough else "INSUFFICIENT_EVIDENCE", None if enough else least - n, times[-1] - times[0] if enough else None,
            n - 1 if enough else None, mid, float(median(abs(g - mid) for g in gaps)) if enough else None, version - 1 if version > 1 else None,
            list(dict.fromkeys([me, *ids])),
        )
        return {"times": times, "ids": ids, "version": version}, [row]

    return step
