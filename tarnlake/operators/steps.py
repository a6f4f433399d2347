"""Named steps in order, factors by name, and calls answered from a cache."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Blocked(Exception):
    """A source refuses access; the other steps go on."""


@dataclass
class Report:
    """One line for each step: done, blocked or failed, and why."""

    lines: list[tuple[str, str, str]] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return all(status != "failed" for _, status, _ in self.lines)


def run_steps(steps: list[tuple[str, Callable[[], object]]], dry: bool = False) -> Report:
    """Runs steps one after the other. A blocked step is noted; any other error ends the run and is noted."""
    report = Report()
    for name, step in steps:
        if dry:
            report.lines.append((name, "planned", ""))
            continue
        try:
            result = step()
            report.lines.append((name, "done", "" if result is None else str(result)))
        except Blocked as why:
            report.lines.append((name, "blocked", str(why)))
        except (ValueError, OSError) as why:
            report.lines.append((name, "failed", str(why)))
            break
    return report


_FACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def factor(name: str):
    """Registers a function from a panel to (trade_date, ts_code, value_raw)."""

    def add(build):
        if name in _FACTORS:
            raise ValueError(f"factor {name} is registered twice")
        _FACTORS[name] = build
        return build

    return add


def factor_panel(panel: DataFrame, names: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """All named factors in one long frame, missing values dropped, within the dates: one lazy plan over one scan."""
    out = None
    for name in names:
        part = _FACTORS[name](panel).select("trade_date", "ts_code", F.lit(name).alias("factor"), "value_raw").where("value_raw is not null")
        out = part if out is None else out.unionByName(part)
    if start:
        out = out.where(F.col("trade_date") >= start)
    return out.where(F.col("trade_date") <= end) if end else out


LEDGER = "key string, reply string, tokens_in long, tokens_out long, cost double"


def cached_calls(requests: DataFrame, cache: DataFrame, client: Callable[[str], str | tuple[str, int, int]], folder: str, price_in: float = 0.0, price_out: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(answers, new): requests (id, payload) answered by sha-256 of the payload from `cache` (key, reply), else by the client.

    Each distinct payload is asked once, on the executors: the replies are written below `folder` before anything reads
    them. `new` holds them with the tokens that the client names and what these cost, to be added to cache and ledger. A
    task that is tried again asks its payloads again.
    """
    keyed = requests.withColumn("key", F.sha2("payload", 256))
    missing = keyed.select("key", "payload").dropDuplicates(["key"]).join(cache, "key", "left_anti")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [client(p) for p in f["payload"]]
            full = [x if isinstance(x, tuple) else (x, 0, 0) for x in got]
            yield pd.DataFrame({
                "key": f["key"].to_numpy(), "reply": [r for r, *_ in full], "tokens_in": [a for _, a, _ in full], "tokens_out": [b for *_, b in full],
                "cost": [a * price_in + b * price_out for _, a, b in full],
            })

    path = f"{folder.rstrip('/')}/replies-{uuid.uuid4().hex}"
    missing.mapInPandas(ask, LEDGER).write.parquet(path)
    new = requests.sparkSession.read.schema(LEDGER).parquet(path)
    known = cache.select("key", "reply").unionByName(new.select("key", "reply"))
    return keyed.join(known, "key", "left").select("id", "reply"), new


def evidence_only(items: DataFrame, field_name: str, quote: str, text: str, allowed: list[str], kind: str) -> DataFrame:
    """Arrays of reported items less those whose kind is not allowed or whose quote does not stand in the text (blanks aside)."""
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    good = F.filter(field_name, lambda x: x[kind].isin(allowed) & squeeze(F.col(text)).contains(squeeze(x[quote])))
    return items.withColumn(field_name, good)
