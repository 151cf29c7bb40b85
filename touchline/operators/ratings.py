"""Chronological rating folds."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import probability as P

K, HOME_ADVANTAGE, START, HALF_LIFE_DAYS = 20.0, 100.0, 1500.0, 365.0


class Chronicle:
    """Ratings of the teams of a pool after the matches seen so far; its size is that of the teams."""

    def __init__(self) -> None:
        self.rating: dict = {}
        self.seen: dict = {}

    def now(self, team, at: int) -> float:
        """A team's rating at a moment: what it was, decayed to the start by half for each half-life since its last match."""
        if team not in self.rating:
            return START
        return START + (self.rating[team] - START) * 0.5 ** ((at - self.seen[team]) / 86400 / HALF_LIFE_DAYS)

    def add(self, matches: pd.DataFrame) -> np.ndarray:
        """home_before, away_before, home_after, away_after of whole moments of matches (ko, home, away, hg, ag, weight), in order of kick-off and id.

        Matches of one moment see only what was before it. A team with two matches at one moment is an error.
        """
        ko, home, away = matches["ko"].to_numpy(), matches["home"].to_numpy(), matches["away"].to_numpy()
        hg, ag, weight = matches["hg"].to_numpy(), matches["ag"].to_numpy(), matches["weight"].to_numpy(float)
        out = np.empty((len(matches), 4))
        starts = np.flatnonzero(np.r_[True, ko[1:] != ko[:-1]]) if len(ko) else np.array([], dtype=int)
        for i, j in zip(starts, np.r_[starts[1:], len(ko)], strict=True):
            news: dict = {}
            for m in range(i, j):
                h, a = self.now(home[m], ko[m]), self.now(away[m], ko[m])
                expected = 1 / (1 + 10 ** (np.clip((a - h - HOME_ADVANTAGE) / 400, -700, 700)))
                gap = abs(int(hg[m]) - int(ag[m]))
                moved = weight[m] * K * (1 + np.log(gap) if gap > 1 else 1.0) * ((1.0 if hg[m] > ag[m] else 0.5 if hg[m] == ag[m] else 0.0) - expected)
                out[m] = h, a, h + moved, a - moved
                for team, value in ((home[m], h + moved), (away[m], a - moved)):
                    if team in news:
                        raise ValueError(f"team {team} has two matches at {ko[m]}")
                    news[team] = value
            for team, value in news.items():
                self.rating[team], self.seen[team] = value, ko[i]
        return out


_AFTER = ["home_before", "away_before", "home_after", "away_after"]


def fold(matches: pd.DataFrame) -> pd.DataFrame:
    """match_id and the ratings before and after matches (match_id, ko, home, away, hg, ag, and weight if there is one) in order of kick-off and id."""
    matches = matches.sort_values(["ko", "match_id"])
    matches = matches if "weight" in matches else matches.assign(weight=1.0)
    return pd.DataFrame(Chronicle().add(matches), columns=_AFTER).assign(match_id=matches["match_id"].to_numpy())[["match_id", *_AFTER]]


def elo(matches: DataFrame, pool: str, weight: str | None = None) -> DataFrame:
    """pool, match_id, ko, home, away and the ratings before and after each match; ``weight`` is a column by which a match counts more or less.

    Ratings of teams that meet are coupled, so a pool of teams (``pool``) is one chronological fold; pools run in parallel. A pool's matches are sorted by Spark and streamed
    through a state of one number per team, so that no pool is ever held as a whole. Rows with a null in any of these have no rating.
    """
    columns = [pool, "match_id", "ko", "home", "away", "hg", "ag"]
    kinds = dict(matches.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        rest = None
        for pdf in itertools.chain(batches, [None]):
            if pdf is None:
                pdf, rest = rest, None
            else:
                pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
                # the batch may end within a moment
                last = (pdf[pool] == pdf[pool].iloc[-1]) & (pdf["ko"] == pdf["ko"].iloc[-1]) if len(pdf) else None
                rest, pdf = (pdf[last], pdf[~last]) if len(pdf) else (None, pdf)
            if pdf is None or not len(pdf):
                continue
            for name, part in pdf.groupby(pool, sort=False):
                if name not in states:
                    states = {name: Chronicle()}  # the pools of a partition come one after the other
                out = pd.DataFrame(states[name].add(part), columns=_AFTER, index=part.index)
                yield pd.concat([part[[pool, "match_id", "ko", "home", "away"]], out], axis=1)

    rows = matches.select(*columns, (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight")).dropna()
    schema = ", ".join(f"{c} {kinds[c]}" for c in (pool, "match_id", "ko", "home", "away")) + ", " + ", ".join(f"{c} double" for c in _AFTER)
    return rows.repartition(pool).sortWithinPartitions(pool, "ko", "match_id").mapInPandas(run, schema)


def ratings_at(rated: DataFrame, pool: str, cutoff: Column) -> DataFrame:
    """pool, team, rating, last: each team's rating at a cutoff (seconds) from the latest match that kicked off strictly before it, decayed to the cutoff."""
    side = lambda team, value: F.struct(F.col(team).alias("team"), F.col(value).alias("rating"))
    long = rated.where(F.col("ko") < cutoff).select(pool, "ko", "match_id", F.inline(F.array(side("home", "home_after"), side("away", "away_after"))))
    last = long.groupBy(pool, "team").agg(F.max_by(F.struct("ko", "rating"), F.struct("ko", "match_id")).alias("l"))
    return last.select(pool, "team", P.elo_decay(F.col("l.rating"), START, (cutoff - F.col("l.ko")) / 86400.0, HALF_LIFE_DAYS).alias("rating"), F.col("l.ko").alias("last"))
