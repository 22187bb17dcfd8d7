"""Outcomes of deliveries over a stream of steps, by keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, delivery_id bigint, entity_id string, tier string, outcome string"


def stream_outcomes(steps: DataFrame) -> DataFrame:
    """Resolved outcomes of a stream (key, at, step, delivery_id, entity_id, tier), by the rule of the batch operator: a touch
    hits what is pending, a pull what is pending as a pointer, a boundary turns the rest into misses. The state of a key holds
    its pending rows; steps are taken in the order of `at` within a trigger."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        out = []
        for s in pd.concat(list(batches)).sort_values("at").itertuples():
            if s.step == "deliver":
                if not any(p[:2] == (s.delivery_id, s.entity_id) for p in pending):
                    pending.append((s.delivery_id, s.entity_id, s.tier))
                continue
            hit = [p for p in pending if s.step == "boundary" or p[1] == s.entity_id and (s.step == "touch" or p[2] == "pointer")]
            out += [(key[0], *p, "miss" if s.step == "boundary" else "hit") for p in hit]
            pending = [p for p in pending if p not in hit]
        state.update((json.dumps([[int(a), b, c] for a, b, c in pending]),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return steps.groupBy("key").applyInPandasWithState(fold, OUT, "pending string", "append", GroupStateTimeout.NoTimeout)
