"""A small budget ledger on the driver: money is reserved before a call and settled after it."""

from __future__ import annotations

import sqlite3
from contextlib import closing
from datetime import datetime, timezone
from decimal import Decimal

#: Dollars for a million tokens: input, output, cache read, cache write (fixed values).
PRICES = {"input": Decimal("3.00"), "output": Decimal("15.00"), "cache_read": Decimal("0.30"), "cache_write": Decimal("3.75")}
RESERVED = Decimal("0.15")


class BudgetExceeded(RuntimeError):
    pass


def cost_of(**tokens: int) -> Decimal:
    return sum((PRICES[k] * n for k, n in tokens.items()), Decimal(0)) / 1_000_000


class Ledger:
    def __init__(self, path: str, cap: Decimal):
        self.path, self.cap = path, cap
        with closing(self._open()) as db:
            db.execute("create table if not exists usage (id integer primary key, called_at text, purpose text, usd text, settled integer)")

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(self.path, isolation_level=None)

    def spent(self) -> Decimal:
        with closing(self._open()) as db:
            return sum((Decimal(x) for (x,) in db.execute("select usd from usage")), Decimal(0))

    def reserve(self, purpose: str) -> int:
        """Takes the lock, refuses what would pass the cap, else notes the reserve and gives its number."""
        db = self._open()
        try:
            db.execute("begin immediate")
            spent = sum((Decimal(x) for (x,) in db.execute("select usd from usage")), Decimal(0))
            if spent + RESERVED > self.cap:
                db.execute("rollback")
                raise BudgetExceeded(f"{spent} of {self.cap} are spent")
            row = db.execute("insert into usage (called_at, purpose, usd, settled) values (?, ?, ?, 0)", (datetime.now(timezone.utc).isoformat(), purpose, str(RESERVED))).lastrowid
            db.execute("commit")
            return row
        finally:
            db.close()

    def settle(self, row: int, **tokens: int) -> None:
        """Puts the true cost in the place of the reserve."""
        with closing(self._open()) as db:
            db.execute("update usage set usd = ?, settled = 1 where id = ?", (str(cost_of(**tokens)), row))
