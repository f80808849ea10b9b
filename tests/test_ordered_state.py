from types import SimpleNamespace

import pandas as pd

from loomwatch.streaming import ordered


class Value:
    def __init__(self):
        self.value, self.calls = None, 0

    def called(self, value=None):
        self.calls += 1
        return value

    def exists(self):
        return self.called(self.value is not None)

    def get(self):
        return self.called(self.value)

    def update(self, value):
        self.value = self.called(value)

    def clear(self):
        self.value = self.called()


class Map(dict):
    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.pop  # noqa: N815


def test_a_call_reads_and_writes_the_state_once():
    """Each access is a round trip to the JVM, of which rows had several each."""
    value, timers = Value(), []
    p = ordered.ThresholdDecisions(3, 3600)
    p.init(SimpleNamespace(getMapState=lambda *a: Map(), getValueState=lambda *a: value, registerTimer=timers.append))
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    list(p.handleInputRows(("k",), iter([pd.DataFrame({"t": [i * 600_000_000 for i in range(200)], "id": range(200)})]), at(0)))
    told = pd.concat(p.handleExpiredTimer(("k",), at(600_000 * 200), None))
    assert len(told) == 202 and (told["decision"] == "match").sum() == 200 and value.calls <= 4
    assert value.value[2] == 600_000 * 199
