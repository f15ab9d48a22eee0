"""Lookups of addresses by providers, behind one interface. No provider of the network is part of the engine: callers bring
them, tests and offline runs use tables."""

from __future__ import annotations

import asyncio
import time
from collections.abc import Awaitable, Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark import rank
from waymark.functions.geo import Box, unswapped

#: An address's answer (label, lat, lon, postcode), or none.
Answer = tuple[str, float, float, str] | None
Provider = Callable[[str], Awaitable[Answer]]


class Limiter:
    """At least ``interval`` seconds between calls of one provider, within one task."""

    def __init__(self, interval: float) -> None:
        self.interval, self._next = interval, 0.0

    async def wait(self) -> None:
        now = time.monotonic()
        at = max(now, self._next)
        self._next = at + self.interval
        await asyncio.sleep(at - now)


async def race(address: str, providers: Sequence[tuple[str, Provider, Limiter]], accept: Callable[[Answer], bool], timeout: float) -> tuple[str, Answer]:
    """The first accepted answer of all providers asked at once, the others cancelled."""

    async def ask(name: str, provider: Provider, limiter: Limiter) -> tuple[str, Answer]:
        await limiter.wait()
        return name, await asyncio.wait_for(provider(address), timeout)

    tasks = [asyncio.create_task(ask(*p)) for p in providers]
    try:
        for done in asyncio.as_completed(tasks):
            try:
                name, answer = await done
            except Exception:  # a provider that fails has no answer; the others may
                continue
            if answer is not None and accept(answer):
                return name, answer
        return "", None
    finally:
        for t in tasks:
            t.cancel()


def geocoded(addresses: DataFrame, column: str, make: Callable[[], Sequence[tuple[str, Provider, float]]], box: Box, tasks: int = 1, timeout: float = 10.0, at_once: int = 12) -> DataFrame:
    """Answers for distinct addresses (A13): ``provider``, ``label``, ``lat``, ``lon``, ``postcode``, swapped coordinates put right.

    ``make`` gives names, providers and intervals, in each task; ``tasks`` bounds how many ask at the same time, so all of them
    keep a provider's rate at ``tasks`` calls in each interval.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        providers = [(n, p, Limiter(i)) for n, p, i in make()]

        def ok(a: Answer) -> bool:
            return a is not None and any(box.south <= lat <= box.north and box.west <= lon <= box.east for lat, lon in ((a[1], a[2]), (a[2], a[1])))

        async def all_of(texts: list[str]) -> list:
            gate = asyncio.Semaphore(at_once)

            async def one(x: str):
                async with gate:
                    return await race(x, providers, ok, timeout)

            return await asyncio.gather(*map(one, texts))

        for batch in batches:
            answers = asyncio.run(all_of(batch["address"].tolist()))
            yield pd.DataFrame([(x, n, *(a or (None,) * 4)) for x, (n, a) in zip(batch["address"], answers, strict=True)], columns=["address", "provider", "label", "lat", "lon", "postcode"])

    distinct = addresses.select(F.col(column).alias("address")).where("address <> ''").distinct().repartition(tasks)
    found = distinct.mapInPandas(work, "address string, provider string, label string, lat double, lon double, postcode string")
    return found.withColumn("_p", unswapped(F.col("lat"), F.col("lon"), box)).withColumns({"lat": F.col("_p.lat"), "lon": F.col("_p.lon")}).drop("_p")


def by_tables(addresses: DataFrame, row_id: str, queries: Sequence[Column], tables: Sequence[tuple[str, DataFrame]], box: Box) -> DataFrame:
    """The first answer inside the box, over a row's queries in order and for each the tables in order.

    Tables have ``address``, ``label``, ``lat``, ``lon``, ``postcode``; of an address's rows the first by label counts.
    """
    asked = addresses.select(row_id, F.posexplode(F.array(*queries)).alias("query", "address")).where("address <> ''")
    found = None
    for i, (name, table) in enumerate(tables):
        p = unswapped(F.col("lat"), F.col("lon"), box)
        inside = table.withColumn("_p", p).withColumns({"lat": F.col("_p.lat"), "lon": F.col("_p.lon")}).where(box.holds(F.col("lat"), F.col("lon")))
        one = rank.first_by(inside.drop("_p"), ["address"], ["label", "lat", "lon"])
        hit = asked.join(one, "address").select(row_id, "query", F.lit(i).alias("table"), F.lit(name).alias("provider"), "label", "lat", "lon", "postcode")
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(row_id).agg(F.min_by(F.struct("provider", "label", "lat", "lon", "postcode"), F.struct("query", "table")).alias("hit"))
    return addresses.join(best, row_id, "left").select(*addresses.columns, "hit.*")


def probed_all(addresses: DataFrame, row_id: str, address: str, tables: Sequence[tuple[str, DataFrame]], box: Box) -> DataFrame:
    """Every answer inside the box of every table, each place once (N4): rows of ``row_id`` that agree in label and in coordinates to six
    digits are one, of the first table that has it.

    Tables are brought down to an address's places before any row meets them. Only rows of a ``row_id`` that asks for several
    addresses can then have a place twice, and only these are compared again.
    """
    found = None
    for i, (name, table) in enumerate(tables):
        p = table.withColumn("_p", unswapped(F.col("lat"), F.col("lon"), box)).withColumns({"lat": F.col("_p.lat"), "lon": F.col("_p.lon")}).drop("_p")
        hit = p.where(box.holds(F.col("lat"), F.col("lon")) & F.col("address").isNotNull())
        hit = hit.select("address", F.lit(i).alias("_i"), F.lit(name).alias("provider"), "label", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "postcode")
        found = hit if found is None else found.unionByName(hit)
    # A minimum for each place: partial ones leave a task little to send, however often an address is listed.
    places = found.groupBy("address", "label", "lat", "lon").agg(F.min(F.struct("_i", "postcode", "provider")).alias("_m"))
    asked = addresses.where(F.col(address).isNotNull()).groupBy(row_id).agg(F.collect_set(F.col(address).cast("string")).alias("_asked"))
    columns = [row_id, "provider", "label", "lat", "lon", "postcode"]
    met = lambda d: d.select(row_id, F.explode("_asked").alias("address")).join(places, "address").select(row_id, "label", "lat", "lon", "_m.*")
    once, again = met(asked.where("size(_asked) = 1")), met(asked.where("size(_asked) > 1"))
    return once.select(*columns).unionByName(rank.first_by(again, [row_id, "label", "lat", "lon"], ["_i", "postcode"]).select(*columns))
