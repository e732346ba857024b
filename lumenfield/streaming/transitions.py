"""Transitions of a viewer to other bands, as a state machine on a stream.

begin (visible tiles, idle workers) starts a transition unless one is on; without visible tiles it
ends at once. Tiles beyond the idle workers go back to the queue and aren't waited for. Each tile
that is done (complete or failed) counts down, not below zero, and the transition is finalised, once,
when a tile is done and none is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .ordered import Ordered, in_order


class Transitions(Ordered):
    """Memory: how many tiles are waited for; nothing without a transition."""

    columns = "t long, seq long, action string, visible int, idle int"
    output = "source_id long, seq long, action string, started boolean, requeued int, remaining int, finalise boolean"

    def step(self, key: tuple, row: dict, memory: dict) -> list[tuple]:
        on, rest = "rest" in memory, memory.get("rest", 0)
        if row["action"] == "begin":
            visible, idle = max(0, row["visible"] or 0), max(0, row["idle"] or 0)
            started = not on and visible > 0
            if started:
                rest = memory["rest"] = min(visible, idle)
            return [(*key, row["seq"], "begin", started, max(0, visible - idle) if started else 0, rest, False)]
        rest = max(0, rest - 1)
        done = on and rest == 0
        if done:
            memory.clear()
        elif on:
            memory["rest"] = rest
        return [(*key, row["seq"], "tile", False, 0, rest, done)]


def transition_stream(actions: DataFrame, late: str = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """The machine on a stream (source_id, seq, ts, action: begin or tile, visible, idle, closed); initial: (source_id, json) with {"rest": n} for transitions that are on."""
    return in_order(actions, ["source_id"], Transitions(), late, initial)
