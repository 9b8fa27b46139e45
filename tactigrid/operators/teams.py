"""Team membership: votes, kit vectors, clusters, keepers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactigrid.config import GOALKEEPER
from tactigrid.operators.tracks import TRACK, majority


def vote(observations: DataFrame) -> DataFrame:
    """(match_id, track_id, team, share) by majority of the observations' teams."""
    return majority(observations, TRACK, "team")


def vote_confidence(votes: DataFrame) -> DataFrame:
    return votes.groupBy("match_id").agg(F.avg("share").alias("confidence"), F.count("*").alias("tracks"))


def mean_kits(observations: DataFrame) -> DataFrame:
    """Mean of the kit vectors (array column ``kit``) of each track."""
    parts = observations.select(*TRACK, F.posexplode("kit").alias("i", "v")).groupBy(*TRACK, "i").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return parts.groupBy(*TRACK).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("kit"), F.max("n").alias("n"))


def fold_votes(votes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Votes (match_id, track_id, team, n) added up over merged tracks, then decided."""
    rows = votes.join(mapping, TRACK, "left").withColumn("track_id", F.coalesce("root", "track_id"))
    return majority(rows, TRACK, "team", F.col("n"))


def assign_keepers(people: DataFrame, teams: DataFrame, classes: DataFrame) -> DataFrame:
    """Keepers take the team whose outfield players are on average farther from them, as those
    attack the other end; needs two teams. Of equally far ones the lower number counts."""
    at = people.where(F.col("pitch_x").isNotNull()).join(classes.select(*TRACK, F.col("cls").alias("settled")), TRACK)
    field = at.where(F.col("settled") != GOALKEEPER).join(teams, TRACK).where(F.col("team").isin(1, 2)).groupBy("match_id", "team").agg(F.avg("pitch_x").alias("mean_x"))
    both = field.groupBy("match_id").agg(F.count("*").alias("n")).where("n = 2").select("match_id")
    keepers = at.where(F.col("settled") == GOALKEEPER).groupBy(*TRACK).agg(F.median("pitch_x").alias("x"))
    return keepers.join(both, "match_id").join(field, "match_id").groupBy(*TRACK).agg(F.max_by("team", F.struct(F.abs(F.col("x") - F.col("mean_x")), F.negative("team"))).alias("team"))


def _two_means(x: np.ndarray, starts: int, seed: int, rounds: int = 100) -> np.ndarray:
    """Labels 0 and 1 of the tightest of ``starts`` runs of Lloyd's algorithm."""
    rng = np.random.default_rng(seed)
    best, labels = np.inf, np.zeros(len(x), int)
    for _ in range(starts):
        first = x[rng.integers(len(x))]
        far = ((x - first) ** 2).sum(axis=1)
        centres = np.stack([first, x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else 0]])
        for _ in range(rounds):
            d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
            own = d.argmin(axis=1)
            new = np.stack([x[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in (0, 1)])
            if np.allclose(new, centres):
                break
            centres = new
        spread = d.min(axis=1).sum()
        if spread < best - 1e-9:
            best, labels = spread, own
    return labels


def cluster_kits(kits: DataFrame, least: int = 8, starts: int = 10, seed: int = 1) -> DataFrame:
    """(match_id, track_id, cluster): the kit vectors of a match in two groups, as kits are worn in
    one match only; cluster 1 is the larger, of equal ones that of the lowest track. A match with
    fewer than ``least`` has cluster 0. The tightest of ``starts`` seeded starts counts; a match,
    which bounds the group, is clustered alone."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("track_id").reset_index(drop=True)
        if len(pdf) < least:
            return pdf.assign(cluster=0)[["match_id", "track_id", "cluster"]]
        own = _two_means(np.array(pdf["kit"].tolist(), float), starts, seed)
        one = own == 1
        larger = int(one.sum() > (~one).sum() or (one.sum() == (~one).sum() and one[0]))
        return pdf.assign(cluster=np.where(own == larger, 1, 2))[["match_id", "track_id", "cluster"]]

    kind = kits.schema["track_id"].dataType.simpleString()
    return kits.select(*TRACK, F.col("kit").cast("array<double>").alias("kit")).groupBy("match_id").applyInPandas(fit, f"match_id bigint, track_id {kind}, cluster int")


def kit_medians(clustered: DataFrame) -> DataFrame:
    """The colour of each cluster of a match: the median of its kit vectors, place by place."""
    parts = clustered.select("match_id", "cluster", F.posexplode("kit").alias("i", "v")).groupBy("match_id", "cluster", "i").agg(F.median("v").alias("v"))
    return parts.groupBy("match_id", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("kit"))
