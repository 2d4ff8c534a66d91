"""Carts as keyed state: what is kept of a user's events lets them come in any order.

For each item the state has the last removal, the last setting, the last add before that setting and the adds after it;
for the user, the last clearing. Each of these only moves forward, so events of any batch, in any order and also twice,
lead to the cart that the whole history leaves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Before every event.
NEVER = -1


@dataclass
class Item:
    """What still matters of one item's events, by their numbers."""

    removed: int = NEVER
    set_at: int = NEVER
    set_to: int = 0
    before: int = NEVER
    adds: dict[int, int] = field(default_factory=dict)

    def take(self, action: str, seq: int, quantity: int) -> None:
        if action == "remove":
            self.removed = max(self.removed, seq)
        elif action == "set" and seq > self.set_at:
            self.set_at, self.set_to = seq, quantity
        elif action == "add":
            self.adds[seq] = max(quantity, 1)
        self.before = max([self.before, *(s for s in self.adds if s < self.set_at)])
        self.adds = {s: n for s, n in self.adds.items() if s > max(self.set_at, self.removed)}

    def quantity(self, cleared: int) -> int | None:
        """None if the item isn't in the cart."""
        start = max(self.removed, cleared)
        added = [n for s, n in self.adds.items() if s > start]
        if self.set_at > start and self.before > start:
            return self.set_to + sum(added)
        return sum(added) if added else None

    def packed(self) -> tuple[int, int, int, int, str]:
        return self.removed, self.set_at, self.set_to, self.before, json.dumps(sorted(self.adds.items()))

    @classmethod
    def unpacked(cls, value: tuple) -> Item:
        *numbers, adds = value
        return cls(*numbers, {int(s): n for s, n in json.loads(adds)})


ITEM = "removed bigint, set_at bigint, set_to bigint, before bigint, adds string"
CART_ROW = "user_id bigint, product_id bigint, quantity bigint"


class Carts(StatefulProcessor):
    """Events of a user to the items whose quantity has changed; null means gone."""

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cleared = handle.getValueState("cleared", "seq bigint", self.idle_ms)
        self.items = handle.getMapState("items", "product_id bigint", ITEM, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        user = key[0]
        was = self.cleared.get()[0] if self.cleared.exists() else NEVER
        cleared, touched, before = was, {}, {}
        for r in rows:
            if r.action == "clear":
                cleared = max(cleared, r.seq)
                continue
            if r.product_id not in touched:
                found = self.items.getValue((r.product_id,)) if self.items.containsKey((r.product_id,)) else None
                touched[r.product_id] = Item.unpacked(found) if found else Item()
                before[r.product_id] = touched[r.product_id].quantity(was)
            touched[r.product_id].take(r.action, r.seq, r.quantity)
        for product, item in touched.items():
            self.items.updateValue((product,), item.packed())
        if cleared > was:
            self.cleared.update((cleared,))
            # clearing can reach items that have no event in this batch
            for (product,), value in self.items.iterator():
                if product not in touched:
                    touched[product] = Item.unpacked(value)
                    before[product] = touched[product].quantity(was)
        for product, item in touched.items():
            now = item.quantity(cleared)
            if now != before[product]:
                yield Row(user_id=user, product_id=product, quantity=now)


def cart_changes(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(user_id, product_id, quantity) of every change that a batch of (user_id, product_id, action, quantity, seq) makes.

    For update mode, with the RocksDB state store. A cart that gets no event for idle_ms is forgotten: its items drop out of
    the state, and later events start from an empty cart.
    """
    mode = "ProcessingTime" if idle_ms else "None"
    return events.groupBy("user_id").transformWithState(Carts(idle_ms), CART_ROW, "Update", mode)
