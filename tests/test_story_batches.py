"""Rows of keyed state that wait are put away batch by batch."""

import json

import pandas as pd

from newsloom.streaming import stories


class _Held(dict):
    """A map state in memory."""

    def getValue(self, key):
        return self.get(key)

    def containsKey(self, key):
        return key in self

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)

    def iterator(self):
        return iter(list(self.items()))


def test_a_batch_of_rows_is_in_memory_at_a_time():
    states, timers = {}, []

    class Handle:
        def getMapState(self, name, *_):
            return states.setdefault(name, _Held())

        def registerTimer(self, at):
            timers.append(at)

    class Expiry:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

    processor = stories.Stories(21, 0.55)
    processor.init(Handle())

    def batches():
        for n in range(4):
            assert sum(len(json.loads(v[0])) for v in states["waiting"].values()) == 6 * n, "rows of an earlier batch are not put away"
            rows = [{"event_id": f"E{n}{k}", "at": (n * 6 + k) * 1_000_000, "day": k % 2, "title": "", "words": [], "cluster_key": f"k{k}", "event_types": [], "has_official": False, "relationship": "DIRECT", "impact_score": n, "direction": "POSITIVE"} for k in range(6)]
            yield pd.DataFrame(rows)

    assert list(processor.handleInputRows(("T",), batches(), None)) == []
    out = pd.concat([frame for at in sorted(set(timers)) for frame in processor.handleExpiredTimer(("T",), None, Expiry(at))])
    assert out["change"].value_counts().to_dict() == {"event added": 6, "impact raised": 18} and not states["waiting"] and not states["pieces"]
