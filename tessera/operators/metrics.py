"""Retrieval, refusal and answer metrics as aggregations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.cumulative import CUTS_OF_PAIRS, below, cuts_of, ordered_pairs, stretch
from tessera.sources.shared import written

#: Depths of the recall curve.
CURVE = (1, 3, 5, 10)
#: Weights of a bootstrap that a worker holds at a time.
ROUND_CELLS = 1 << 17


def anchor_ranks(anchors: DataFrame, hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """The anchors (query_id, doc, quote) with `rank` of the first hit of their document that holds their quote, at any depth; null if none."""
    near = anchors.join(hits.select(query_id, "doc", F.col("rank").alias("at"), "text"), [query_id, "doc"], "left")
    good = F.when(F.col("text").contains(F.col("quote")), F.col("at"))
    return near.groupBy(query_id, "doc", "quote").agg(F.min(good).alias("rank"))


def missing_anchors(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.where(F.coalesce(F.col("rank") > k, F.lit(True)))


def relevant_hits(hits: DataFrame, anchors: DataFrame, query_id: str = "query_id") -> DataFrame:
    """The hits with `relevant`: some anchor of the question is of their document and in their text."""
    own = anchors.groupBy(query_id, "doc").agg(F.collect_set("quote").alias("quotes"))
    return hits.join(own, [query_id, "doc"], "left").withColumn("relevant", F.coalesce(F.exists("quotes", lambda q: F.col("text").contains(q)), F.lit(False))).drop("quotes")


def ranking_metrics(hits: DataFrame, k: int, query_id: str = "query_id") -> DataFrame:
    """hits: (query_id, rank, relevant). Per query: precision (of k, not of what came back), reciprocal rank within k, first relevant rank at any depth."""
    good, within = F.col("relevant"), F.col("rank") <= k
    first = F.min(F.when(good & within, F.col("rank")))
    return hits.groupBy(query_id).agg((F.count_if(good & within) / k).alias("precision"), F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"), F.min(F.when(good, F.col("rank"))).alias("first_rank"))


def recall_curve(ranked: DataFrame, depths: Sequence[int] = CURVE, query_id: str = "query_id") -> DataFrame:
    """Rows (query_id, recall_1, ...): share of the anchors found at each depth, out of one ranking."""
    return ranked.groupBy(query_id).agg(*(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")).alias(f"recall_{k}") for k in depths))


def grouped_means(per_query: DataFrame, groups: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Means over everything, and over each value of each group, in one pass: the group's columns are null where a row isn't of it. No rows: one row of zeros."""
    sets = [[], *([g] for g in groups)]
    return per_query.groupingSets([[F.col(g) for g in s] for s in sets], *groups).agg(F.count("*").alias("n"), *(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in measures))


def mean_of(per_query: DataFrame, measure: str, ids: Sequence, query_id: str = "query_id") -> DataFrame:
    """One row: the mean over a fixed list of questions, 0 if none is there."""
    return per_query.agg(F.coalesce(F.avg(F.when(F.col(query_id).isin(list(ids)), F.col(measure))), F.lit(0.0)).alias(measure))


def top_scores(questions: DataFrame, hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Rows (query_id, top_score): the first hit's score, 0 without hits."""
    top = hits.where("rank = 1").select(query_id, F.col("score").alias("top_score"))
    return questions.select(query_id).join(top, query_id, "left").withColumn("top_score", F.coalesce("top_score", F.lit(0.0)))


def _counted(rows: DataFrame, positive: Column, score: Column) -> DataFrame:
    """Rows (s, pos, neg): positive and negative rows of each score."""
    return rows.select(positive.alias("p"), score.cast("double").alias("s")).where("p is not null and s is not null").groupBy("s").agg(F.count_if("p").alias("pos"), F.count_if(~F.col("p")).alias("neg"))


def auc(rows: DataFrame, positive: Column, score: Column) -> DataFrame:
    """One row (n_pos, n_neg, auc), ties half; 0 where a side is empty. Negatives below a score are counted by stretches of scores, so no task orders them all."""
    placed = below(_counted(rows, positive, score), "s", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2))
    n_pos, n_neg = F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0))
    return placed.agg(n_pos.alias("n_pos"), n_neg.alias("n_neg"), F.coalesce(F.try_divide(wins, n_pos * n_neg), F.lit(0.0)).alias("auc"))


def overlap(rows: DataFrame, positive: Column, score: Column) -> DataFrame:
    """One row: negatives that score at least what the lowest positive does."""
    lowest = rows.where(positive).agg(F.min(score).alias("lowest"))
    return rows.crossJoin(F.broadcast(lowest)).agg(F.count_if(~positive & (score >= F.col("lowest"))).alias("overlap"))


def summary(rows: DataFrame, value: Column) -> DataFrame:
    """One row: least, mean, median and largest value."""
    return rows.agg(F.min(value).alias("least"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("most"))


def repeated_summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Summary over groups of the median of each group's repeats."""
    return summary(rows.groupBy(group).agg(F.percentile(value, F.lit(0.5)).alias("of_group")), F.col("of_group"))


def paired_auc(rows: DataFrame, positive: Column, first: Column, second: Column) -> DataFrame:
    """One row comparing two scores on the same questions: both AUCs over pairs (positive, negative), their difference, and the pairs that only one orders rightly.

    Pairs are counted, never made: of all that one score orders rightly, those that both do are taken off. Rows with a null score are left out.
    """
    judged = rows.select(positive.alias("p"), first.cast("double").alias("a"), second.cast("double").alias("b")).where("p is not null and a is not null and b is not null")
    # Read a dozen times below.
    judged = written(judged, "judged")
    both = ordered_pairs(judged, "p", "a", "b")
    sides = []
    for name, score in (("first", "a"), ("second", "b")):
        placed = below(_counted(judged, F.col("p"), F.col(score)), "s", ["neg"])
        pairs = F.coalesce(F.sum("pos") * F.sum("neg"), F.lit(0))
        ordered = F.coalesce(F.sum(F.col("pos") * F.col("below_neg")), F.lit(0))
        wins = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2))
        sides.append(placed.agg(F.coalesce(F.try_divide(wins, pairs), F.lit(0.0)).alias(f"auc_{name}"), (ordered - both).cast("long").alias(f"only_{name}")))
    # One row each.
    return sides[0].crossJoin(sides[1]).select("auc_first", "auc_second", (F.col("auc_first") - F.col("auc_second")).alias("delta"), "only_first", "only_second")


def paired_bootstrap(rows: DataFrame, positive: Column, first: Column, second: Column, key: Column, rounds: int = 5000, seed: int = 0) -> DataFrame:
    """One row (low, high): where 95 of 100 differences of the two AUCs lie when the rows are drawn again with replacement.

    In each round a row counts as often as a Poisson variable of mean 1 says that a hash of its key and the round gives, so rows stay
    where they are and a run repeats itself; rows of one key are drawn together. Each score is cut into stretches; a stretch
    gives each round's sums of weights and of ordered pairs within it, and what comes to one place is stretches times rounds.
    """
    points = rows.select(positive.alias("p"), first.cast("double").alias("a"), second.cast("double").alias("b"), F.xxhash64(key).alias("h")).where("p is not null and a is not null and b is not null")
    # Read by the cuts and by either side.
    points = written(points, "points")
    cuts = cuts_of(points, ["a", "b"], CUTS_OF_PAIRS)
    sides = [points.select(F.lit(k).alias("side"), stretch(F.col(c), cuts[k]).alias("at"), "p", F.col(c).alias("s"), "h") for k, c in enumerate(("a", "b"))]
    dealt = sides[0].unionByName(sides[1])
    shape = "side int, at int, round int, pos double, neg double, inside double"

    def open_stretch(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("s")
        value = np.cumsum(np.concatenate([[0], np.diff(rows["s"]) > 0]))
        p, h = rows["p"].to_numpy(bool), rows["h"].to_numpy(np.int64).astype(np.uint64)
        of_side = [(h[own], *np.unique(value[own], return_index=True)) for own in (p, ~p)]
        found = np.zeros((3, rounds))
        step = max(1, ROUND_CELLS // len(rows))
        for a in range(0, rounds, step):
            part = np.arange(a, min(rounds, a + step))
            pos, neg = np.zeros((2, value[-1] + 1, len(part)))
            for sums, (keys, values, starts) in zip((pos, neg), of_side, strict=True):
                if len(keys):
                    sums[values] = np.add.reduceat(poisson(keys, part.astype(np.uint64), seed), starts, axis=0, dtype=np.int64)
            found[:, part] = pos.sum(0), neg.sum(0), np.einsum("ij,ij->j", pos, np.cumsum(neg, 0) - neg / 2)
        return pd.DataFrame({"side": rows["side"].iloc[0], "at": rows["at"].iloc[0], "round": np.arange(rounds), "pos": found[0], "neg": found[1], "inside": found[2]})

    def one_value(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Any part of a stretch of one value adds up: nothing in it is ordered. A task tells each stretch once.
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for (side, at), own in batch.groupby(["side", "at"]):
                held = sums.setdefault((side, at), np.zeros((2, rounds)))
                p, h = own["p"].to_numpy(bool), own["h"].to_numpy(np.int64).astype(np.uint64)
                step = max(1, ROUND_CELLS // len(h))
                for a in range(0, rounds, step):
                    part = np.arange(a, min(rounds, a + step))
                    w = poisson(h, part.astype(np.uint64), seed)
                    held[0, part] += w[p].sum(0, dtype=np.int64)
                    held[1, part] += w[~p].sum(0, dtype=np.int64)
        for (side, at), (pos, neg) in sums.items():
            yield pd.DataFrame({"side": side, "at": at, "round": np.arange(rounds), "pos": pos, "neg": neg, "inside": 0.0})

    between = dealt.where("at % 2 = 0").groupBy("side", "at").applyInPandas(open_stretch, shape)
    alone = dealt.where("at % 2 = 1").mapInPandas(one_value, shape)
    per = between.unionByName(alone).groupBy("side", "at", "round").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "inside")))
    before = F.coalesce(F.sum("neg").over(Window.partitionBy("side", "round").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    inside = F.when(F.col("at") % 2 == 1, F.col("pos") * F.col("neg") / 2).otherwise(F.col("inside"))
    areas = per.select("side", "round", "pos", "neg", (F.col("pos") * before + inside).alias("wins")).groupBy("side", "round").agg(F.coalesce(F.try_divide(F.sum("wins"), F.sum("pos") * F.sum("neg")), F.lit(0.0)).alias("auc"))
    deltas = areas.groupBy("round").agg(F.sum(F.when(F.col("side") == 0, F.col("auc")).otherwise(-F.col("auc"))).alias("delta"))
    # One number a round.
    placed = deltas.withColumn("place", F.row_number().over(Window.orderBy("delta")) - 1)
    at = lambda share: F.max(F.when(F.col("place") == min(int(share * rounds), rounds - 1), F.col("delta")))
    return placed.agg(at(0.025).alias("low"), at(0.975).alias("high"))


def poisson(keys: np.ndarray, rounds: np.ndarray, seed: int = 0) -> np.ndarray:
    """Draws of a Poisson variable of mean 1, a row a key and a column a round, by hashes of both."""
    x = keys[:, None] + (rounds[None] + np.uint64(seed) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    # Nearly all shares are told by their first bits; those that share them with a step are looked up by the whole.
    head = (x >> np.uint64(64 - _HEAD)).astype(np.intp)
    draws = _DRAWS[head]
    open_ = np.nonzero(draws == _OPEN)
    draws[open_] = _terms(x[open_])
    return draws


def _terms(x: np.ndarray) -> np.ndarray:
    """The number of terms of the distribution that lie below the share."""
    return np.searchsorted(_STEPS, (x >> np.uint64(11)) / float(1 << 53), side="right").astype(np.uint8)


_STEPS = np.cumsum([np.exp(-1) / factorial(k) for k in range(16)])
_HEAD, _OPEN = 16, 255
_DRAWS = _terms(np.arange(1 << _HEAD, dtype=np.uint64) << np.uint64(64 - _HEAD))
_DRAWS[_DRAWS != _terms((np.arange(1 << _HEAD, dtype=np.uint64) << np.uint64(64 - _HEAD)) | np.uint64((1 << 64 - _HEAD) - 1))] = _OPEN


def confusion(rows: DataFrame, positive: Column, score: Column, threshold: float) -> DataFrame:
    """One row: true_accept, false_accept, false_refuse, true_refuse at score >= threshold."""
    accepted = score >= threshold
    return rows.agg(F.count_if(positive & accepted).alias("true_accept"), F.count_if(~positive & accepted).alias("false_accept"), F.count_if(positive & ~accepted).alias("false_refuse"), F.count_if(~positive & ~accepted).alias("true_refuse"))


def best_thresholds(rows: DataFrame, positive: Column, score: Column) -> DataFrame:
    """One row: the observed score of the highest accuracy (of equals the lowest), that accuracy, and the least threshold that accepts no negative."""
    per = _counted(rows, positive, score)
    whole = per.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    right = F.col("all_pos") - F.col("below_pos") + F.col("below_neg")
    # One row of totals.
    tried = below(per, "s", ["pos", "neg"]).crossJoin(F.broadcast(whole)).select("s", "neg", (right / (F.col("all_pos") + F.col("all_neg"))).alias("accuracy"))
    clean = F.coalesce(F.max(F.when(F.col("neg") > 0, F.col("s"))) + 1e-9, F.min("s"))
    return tried.agg(F.max_by("s", F.struct("accuracy", -F.col("s"))).alias("threshold"), F.max("accuracy").alias("accuracy"), clean.alias("no_false_accept"))


def answer_labels(results: DataFrame) -> DataFrame:
    """The results (expected, refused, content_ok, gated) with `label` and `stage` of a refusal."""
    answerable = F.col("expected") == "answer"
    label = F.when(~answerable & ~F.col("refused"), "fabricated").when(~answerable, "correct_refusal").when(F.col("refused"), "needless_refusal").when(F.coalesce("content_ok", F.lit(False)), "correct").otherwise("wrong")
    return results.withColumn("label", label).withColumn("stage", F.when(F.col("refused"), F.when(F.col("gated"), "stage1").otherwise("stage2")))


def abstention_matrix(labelled: DataFrame) -> DataFrame:
    """One row: how often each label occurs, and the refusals of either stage."""
    names = ("fabricated", "correct_refusal", "needless_refusal", "correct", "wrong")
    return labelled.agg(F.count("*").alias("n"), *(F.count_if(F.col("label") == x).alias(x) for x in names), *(F.count_if(F.coalesce(F.col("stage") == s, F.lit(False))).alias(s) for s in ("stage1", "stage2")))


def rate(hit: Column, of: Column) -> list[Column]:
    """hit, total and percent; no percent of nothing."""
    n, total = F.count_if(hit & of), F.count_if(of)
    return [n.alias("hit"), total.alias("total"), F.try_divide(100 * n, total).alias("percent")]


def judge_report(results: DataFrame, by: str) -> DataFrame:
    """Per group: answers that the checks and the judge hold for right, those that the judge didn't decide, and disagreements. results: (det_ok, judge_verdict)."""
    said = F.col("judge_verdict")
    right = said == "right"
    return results.groupBy(by).agg(F.count("*").alias("n"), F.count_if("det_ok").alias("by_checks"), F.count_if(F.coalesce(right, F.lit(False))).alias("by_judge"), F.count_if(said.isNull()).alias("undecided"), F.count_if(F.coalesce(right != F.col("det_ok"), F.lit(False))).alias("disagreed"))


def paired_difference(before: DataFrame, after: DataFrame, measure: str, query_id: str = "query_id", least: float = 1e-9) -> DataFrame:
    """Rows (query_id, before, after, difference) of the questions whose measure changed."""
    both = before.select(query_id, F.col(measure).alias("before")).join(after.select(query_id, F.col(measure).alias("after")), query_id)
    return both.withColumn("difference", F.col("after") - F.col("before")).where(F.abs("difference") > least)


def best_by(rows: DataFrame, name: str, order: str, *keys: str) -> DataFrame:
    """One row (name, n_tied): the row with the greatest keys, of equals the first in `order`, and how many share them."""
    most = F.max(F.struct(*keys))
    tied = rows.join(F.broadcast(rows.agg(most.alias("most"))), F.struct(*keys) == F.col("most"))
    return tied.agg(F.min_by(name, order).alias(name), F.count("*").alias("n_tied"))
