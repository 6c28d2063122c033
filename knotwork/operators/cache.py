"""The query cache (K01-K07): a small store on the driver for collected results, and its rules as tables."""

from __future__ import annotations

import hashlib
import json
import sqlite3
import threading
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.config import Settings


def key_of(query: str, mode: str = "hybrid", near: str | None = None, limit: int = 5, folder: str | None = None, tags: Iterable[str] | None = None) -> str:
    """The same key as functions.text.cache_key."""
    names = sorted(t.strip(" ").lstrip("#").strip(" ").lower() for t in tags or [])
    parts = [" ".join((query or "").strip(" ").lower().split()), mode.strip().lower(), (near or "").strip().lower(), str(limit), (folder or "").strip().lower().strip("/"), ",".join(names)]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


class QueryCache:
    """Results by key with the notes they depend on; least recently used entries go first.

    Empty results are not kept. path ":memory:" keeps nothing beyond the process.
    """

    def __init__(self, path: str = ":memory:", settings: Settings | None = None, clock: Callable[[], float] = time.time):
        s = settings or Settings()
        self.most, self.ttl, self.clock = s.cache_max_entries, s.cache_ttl_s, clock
        self.lock = threading.Lock()
        self.db = sqlite3.connect(path, check_same_thread=False)
        self.db.executescript(
            "CREATE TABLE IF NOT EXISTS entries(key TEXT PRIMARY KEY, query TEXT, result TEXT, created REAL, used REAL);"
            "CREATE TABLE IF NOT EXISTS needs(key TEXT, note TEXT, PRIMARY KEY(key, note));"
            "CREATE INDEX IF NOT EXISTS by_note ON needs(note);"
            "CREATE TABLE IF NOT EXISTS counters(name TEXT PRIMARY KEY, n INTEGER);"
        )

    def _count(self, name: str, by: int = 1) -> None:
        self.db.execute("INSERT INTO counters VALUES(?, ?) ON CONFLICT(name) DO UPDATE SET n = n + excluded.n", (name, by))

    def _drop(self, keys: list[str]) -> int:
        for k in keys:
            self.db.execute("DELETE FROM entries WHERE key = ?", (k,))
            self.db.execute("DELETE FROM needs WHERE key = ?", (k,))
        return len(keys)

    def get(self, key: str) -> list[dict] | None:
        with self.lock, self.db:
            row = self.db.execute("SELECT result, created FROM entries WHERE key = ?", (key,)).fetchone()
            if row and self.ttl is not None and self.clock() - row[1] > self.ttl:
                self._drop([key])
                row = None
            self._count("hits" if row else "misses")
            if not row:
                return None
            self.db.execute("UPDATE entries SET used = ? WHERE key = ?", (self.clock(), key))
            return json.loads(row[0])

    def put(self, key: str, query: str, rows: list[dict], notes: Iterable[str]) -> None:
        """notes: those the result depends on; the notes of the rows and the resolved focus."""
        if not rows:
            return
        now = self.clock()
        with self.lock, self.db:
            self._drop([key])
            self.db.execute("INSERT INTO entries VALUES(?,?,?,?,?)", (key, query, json.dumps(rows, default=str), now, now))
            self.db.executemany("INSERT OR IGNORE INTO needs VALUES(?,?)", [(key, n) for n in notes])
            n = self.db.execute("SELECT count(*) FROM entries").fetchone()[0]
            if n > self.most:
                old = self.db.execute("SELECT key FROM entries ORDER BY used, key LIMIT ?", (surplus(n, self.most),)).fetchall()
                self._count("evictions", self._drop([k for (k,) in old]))

    def evict_for(self, notes: Iterable[str]) -> int:
        """Drops what depends on one of the notes; how many."""
        with self.lock, self.db:
            keys = {k for n in notes for (k,) in self.db.execute("SELECT key FROM needs WHERE note = ?", (n,))}
            self._count("evictions", len(keys))
            return self._drop(sorted(keys))

    def clear(self) -> int:
        with self.lock, self.db:
            n = self.db.execute("SELECT count(*) FROM entries").fetchone()[0]
            for t in ("entries", "needs", "counters"):
                self.db.execute(f"DELETE FROM {t}")
            return n

    def stats(self) -> dict:
        with self.lock:
            c = dict(self.db.execute("SELECT name, n FROM counters").fetchall())
            n, size = self.db.execute("SELECT count(*), coalesce(sum(length(result)), 0) FROM entries").fetchone()
        asked = c.get("hits", 0) + c.get("misses", 0)
        return {"entries": n, "hits": c.get("hits", 0), "misses": c.get("misses", 0), "hit_rate": round(c.get("hits", 0) / asked, 4) if asked else 0.0, "evictions": c.get("evictions", 0), "bytes": size}


def surplus(n: int, most: int) -> int:
    """How many entries go once there are more than the most: the surplus and a tenth of the most."""
    return max(1, n - most + int(most * 0.1)) if n > most else 0


def lru_victims(entries: DataFrame, most: int) -> DataFrame:
    """cache_key of the entries(cache_key, last_accessed_at) that go: a count, then a top-k without a global sort."""
    return entries.orderBy("last_accessed_at", "cache_key").limit(surplus(entries.count(), most)).select("cache_key")


def dependents(needs: DataFrame, changed: DataFrame) -> DataFrame:
    """cache_key of needs(cache_key, note_path) that depend on one of changed(note_path)."""
    return needs.join(changed.select("note_path").distinct(), "note_path", "left_semi").select("cache_key").distinct()


def hit_rate(accesses: DataFrame) -> DataFrame:
    """hits, misses and hit_rate of accesses(cache_key, at): the first access of a key is a miss."""
    keys = accesses.groupBy("cache_key").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.sum(F.col("n") - 1).alias("hits"), F.count(F.lit(1)).alias("misses")).withColumn("hit_rate", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 4))
