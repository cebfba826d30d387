"""Source attribution for all alerts at once: candidates, evidence, weighted score, verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivertrace import fixed_values as V
from rivertrace.functions.timeparts import hour_set, percent, rounded, rounded_even, set_overlap
from rivertrace.operators.composition import component_shares, score_compositions, share_score
from rivertrace.operators.network import top_sources
from rivertrace.operators.periodicity import periodicity_from
from rivertrace.operators.spectra import rank_candidates, score_pairs
from rivertrace.session import write_once

FIRST_CUT, HYPOTHESES = 6, 4  # fixed values: candidates looked at and hypotheses kept
PATTERN_KEY = ["etype", "station_id", "indicator", "onset_ts", "enterprise_id"]  # what the pattern score of a hypothesis depends on
BONUS = {"periodic": 0.15, "gradual": 0.10}  # fixed values: prior bonus by event type


def prior(atten: Column, position: Column, bonus: Column) -> Column:
    return F.bround(F.least(F.lit(0.6), atten * 50 + bonus + 0.25 - position * 0.02), 3)


def station_hypotheses(sources: DataFrame) -> DataFrame:
    """Ranked candidates per station and prior bonus (three bonus values cover every event type).

    The ranking depends on the station and the event type alone, so it is made once per station and
    not once per alert: at most four rows per (station, bonus).
    """
    bonuses = sorted({0.0, *BONUS.values()})
    scored = (
        top_sources(sources, FIRST_CUT)
        .withColumn("bonus", F.explode(F.array(*[F.lit(b) for b in bonuses])))
        .withColumn("prior", prior(F.col("atten"), F.col("position"), F.col("bonus")))
    )
    order = Window.partitionBy("station_id", "bonus").orderBy(F.desc("prior"), "position")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= HYPOTHESES)
        .drop("position")
    )


def event_bonus(etype: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(0.0))
    for name, value in BONUS.items():
        chain = chain.when(etype == name, F.lit(value))
    return chain.otherwise(F.lit(0.0))


def generate_hypotheses(events: DataFrame, ranked: DataFrame) -> DataFrame:
    """(event columns, hypothesis h1..h4, enterprise_id, name, industry, node_id, prior) per alert.

    ``ranked`` comes from station_hypotheses; ``events`` has id, station_id, etype and what rides along. Alerts without an upstream
    enterprise have no row here; the verdict reports them as failed.
    """
    keyed = events.withColumn("bonus", event_bonus(F.col("etype")))
    return (
        keyed.withColumnRenamed("id", "event_id")
        .join(ranked, ["station_id", "bonus"])
        .withColumn("hypothesis", F.concat(F.lit("h"), F.col("rank").cast("string")))
        .drop("bonus")
    )


def with_candidates(rows: DataFrame, ranked: DataFrame) -> DataFrame:
    """Hypotheses that travelled as (station_id, etype, rank) with what ``ranked`` has of the candidate.

    ``ranked`` has a few rows per station, so names and factors need not be shuffled with every alert.
    """
    kept = [c for c in ranked.columns if c not in rows.columns or c in ("station_id", "rank")]
    keyed = rows.withColumn("bonus", event_bonus(F.col("etype")))
    found = keyed.join(ranked.select(*kept), ["station_id", "bonus", "rank"]).drop("bonus")
    return found.withColumn("hypothesis", F.concat(F.lit("h"), F.col("rank").cast("string")))


def spectrum_evidence(hypotheses: DataFrame, samples: DataFrame, library: DataFrame, ranked: bool = False) -> DataFrame:
    """Spectrum score per (sample_id, enterprise_id) named by the hypotheses.

    With ``ranked`` also the candidate's place in the whole library (``eem_rank``) and the best match of the sample
    (``eem_top``), which the verdict does not need.
    """
    scored = (rank_candidates if ranked else score_pairs)(hypotheses, samples, library)
    places = [F.col("rank").alias("eem_rank"), F.col("top").alias("eem_top")] if ranked else []
    return scored.select(
        "sample_id", "enterprise_id",
        F.bround("cosine", 4).alias("cosine"), F.bround("pearson", 4).alias("pearson"),
        F.bround("score", 4).alias("eem"), *places,
    )


def composition_evidence(hypotheses: DataFrame, observed: DataFrame, library: DataFrame) -> DataFrame:
    """Composition score per (event_id, enterprise_id)."""
    pairs = hypotheses.select(F.col("event_id").alias("sample_id"), "enterprise_id")
    return score_compositions(pairs, observed, library).select(
        F.col("sample_id").alias("event_id"), "enterprise_id", rounded(F.col("score"), 4).alias("pollutant")
    )


def with_composition(hypotheses: DataFrame, observed: DataFrame, library: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``pollutant``, the composition score, null where an event or a candidate has no parts.

    ``observed(event_id, component, amount)`` and ``library(enterprise_id, component, amount)`` are parts with components
    of ``names``. A hypothesis meets its event's shares once, so the score needs no join of its own.
    """
    if not names:
        return hypotheses.withColumn("pollutant", F.lit(None).cast("double"))
    seen = component_shares(observed, "event_id", names).withColumnRenamed("shares", "seen")
    known = component_shares(library, "enterprise_id", names).withColumnRenamed("shares", "known")
    score = rounded(share_score(F.col("seen"), F.col("known"), len(names)), 4)
    return (
        hypotheses.join(seen, "event_id", "left").join(known, "enterprise_id", "left")
        .withColumn("pollutant", score).drop("seen", "known")
    )


def pattern_evidence(
    hypotheses: DataFrame, readings: DataFrame, enterprises: DataFrame, look_back_days: int = 7, **settings
) -> DataFrame:
    """Overlap of active hours at the station with working hours of the enterprise, periodic alerts only.

    ``hypotheses`` carries ``indicator`` and ``onset_ts``. All alerts with the same station, indicator and onset share a
    slice and, for one enterprise, the score: one row per (``PATTERN_KEY``), however many alerts there are. It is saved, so
    that Spark knows how few rows meet the hypotheses.
    """
    since = F.col("onset_ts") - F.make_dt_interval(F.lit(look_back_days))
    wanted = hypotheses.where(F.col("etype") == "periodic").select(*PATTERN_KEY).distinct().withColumn("since", since)
    slices = periodicity_from(readings, wanted, **settings).withColumn(
        "seen_hours", F.array_distinct(F.transform("active_hours", lambda h: h.cast("int")))
    )
    hours = F.coalesce(F.col("discharge_pattern.active_hours"), F.array(F.lit(0), F.lit(24)))
    working = enterprises.select(
        F.col("id").alias("enterprise_id"), hour_set(hours[0], hours[1]).alias("working_hours")
    )
    overlap = set_overlap(F.col("seen_hours"), F.col("working_hours"))
    scored = (
        wanted.join(slices, ["station_id", "indicator", "since"])
        .join(working, "enterprise_id")
        .select(
            *PATTERN_KEY,
            rounded_even(
                F.least(F.lit(1.0), overlap * F.col("strength") + F.col("night_share") * 0.1), 3
            ).alias("pattern"),
        )
    )
    return write_once(scored, "patterns")


def travel_score(travel_h: Column) -> Column:
    """Closer is more suspect inside a 12 h window."""
    return F.bround(F.greatest(F.lit(0.0), 1.0 - F.bround(travel_h, 2) / 12.0), 3)


def with_evidence(
    hypotheses: DataFrame, spectrum: DataFrame, composition: DataFrame | None, pattern: DataFrame, ranked: DataFrame | None = None
) -> DataFrame:
    """One column per kind of evidence, null where there is none.

    The travel score needs no join: candidates already carry ``travel_h``, or get it from ``ranked`` at the end
    (``with_candidates``); nor does the composition if they carry ``pollutant``.
    """
    scored = hypotheses.join(spectrum, ["sample_id", "enterprise_id"], "left")
    if composition is not None:
        scored = scored.join(composition, ["event_id", "enterprise_id"], "left")
    scored = scored.join(pattern, PATTERN_KEY, "left")
    if ranked is not None:
        scored = with_candidates(scored, ranked)
    return scored.withColumn(
        "strength", F.when(F.col("etype") == "sudden", travel_score(F.col("travel_h")))
    )


def verify_hypotheses(evidence: DataFrame) -> DataFrame:
    """Weighted mean over the evidence present; below 0.3 a candidate is rejected."""
    kinds = list(V.EVIDENCE_WEIGHTS.items())
    present = [F.col(name).isNotNull().cast("int") for name, _ in kinds]
    weight = reduce(
        lambda a, b: a + b, [F.when(F.col(n).isNotNull(), F.lit(w)).otherwise(0.0) for n, w in kinds]
    )
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(n) * w, F.lit(0.0)) for n, w in kinds])
    fused = F.when(weight > 0, F.bround(F.least(F.lit(1.0), F.try_divide(total, weight)), 3))
    return (
        evidence.withColumn("evidence_count", reduce(lambda a, b: a + b, present))
        .withColumn("score", F.coalesce(fused, F.col("prior")))
        .withColumn("status", F.when(F.col("score") < V.REJECT_BELOW, "rejected").otherwise("candidate"))
    )


def evidence_rows(verified: DataFrame) -> DataFrame:
    """Long form: one row per (event, hypothesis, kind) with value and weight."""
    kinds = list(V.EVIDENCE_WEIGHTS.items())
    entry = F.array(
        *[F.struct(F.lit(n).alias("kind"), F.col(n).alias("value"), F.lit(w).alias("weight")) for n, w in kinds]
    )
    return (
        verified.withColumn("e", F.explode(entry))
        .where("e.value IS NOT NULL")
        .select("event_id", "hypothesis", "enterprise_id", "e.kind", "e.value", "e.weight")
    )


def conclude(events: DataFrame, verified: DataFrame) -> DataFrame:
    """One verdict per alert: the best candidate from 0.6 on, otherwise failed with a reason."""
    best = (
        verified.groupBy("event_id")
        .agg(
            F.max(
                F.when(
                    F.col("status") == "candidate",
                    F.struct(
                        "score", (-F.col("rank")).alias("order"), "enterprise_id", "name", "industry", "evidence_count"
                    ),
                )
            ).alias("best"),
            F.count(F.lit(1)).alias("hypotheses"),
        )
    )
    resolved = F.coalesce(F.col("best.score") >= V.RESOLVE_FROM, F.lit(False))
    none = F.col("hypotheses").isNull()

    def texts(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    summary = F.concat(
        F.lit("综合 EEM 指纹、污染物谱、排放规律等 "), F.col("best.evidence_count").cast("string"),
        F.lit(" 项证据，锁定 "), F.col("best.name"), F.lit("（置信度 "), percent(F.col("best.score")), F.lit("）"),
    )
    return events.withColumnRenamed("id", "event_id").join(best, "event_id", "left").select(
        *["event_id" if c == "id" else c for c in events.columns],
        F.when(resolved, F.col("best.enterprise_id")).alias("source_id"),
        F.when(resolved, F.col("best.name")).alias("source_name"),
        F.when(resolved, F.col("best.industry")).alias("industry"),
        F.when(resolved, F.col("best.score")).otherwise(0.0).alias("confidence"),
        F.when(resolved, "resolved").otherwise("failed").alias("verdict"),
        F.when(resolved, summary).alias("evidence_summary"),
        F.when(~resolved, F.when(none, V.NO_SOURCE_REASON).otherwise(V.LOW_SCORE_REASON)).alias("reason"),
        F.when(
            ~resolved,
            F.when(none, texts(V.NO_SOURCE_SUGGESTIONS)).otherwise(texts(V.LOW_SCORE_SUGGESTIONS)),
        ).alias("suggestions"),
    )


def verdict_against_truth(verdicts: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds truth_source and ``hit``: null where no investigation was resolved."""
    return verdicts.join(truth, "event_id", "left").withColumn(
        "hit", F.when(F.col("verdict") == "resolved", F.col("source_id").eqNullSafe(F.col("truth_source")))
    )


def accuracy_table(compared: DataFrame, by: str = "etype") -> DataFrame:
    return compared.groupBy(by).agg(
        F.count(F.lit(1)).alias("events"),
        F.count("hit").alias("resolved"),
        F.sum(F.coalesce(F.col("hit"), F.lit(False)).cast("bigint")).alias("hits"),
        (
            F.sum(F.coalesce(F.col("hit"), F.lit(False)).cast("bigint")) / F.nullif(F.count("hit"), F.lit(0))
        ).alias("hit_rate"),
    )
