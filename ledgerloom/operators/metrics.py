"""Figures over outcomes and what is known of them: match rates, values, minutes, cost, recall.

Labels are tables: cases (case_id, true_category), links (batch_id,
bank_txn_id, true_category) and rows (row_id, true_category). A rate over
nothing is null, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import rate

#: The categories that may be put to a model.
MODEL_CATEGORIES = ("UTR_TRUNCATED_MAPPING", "UTR_MISSING_MAPPING", "DUPLICATE_CANDIDATE", "SPLIT_SETTLEMENT", "MISSING_VS_LATE_CREDIT", "UNEXPLAINED")


def _n() -> Column:
    return F.count(F.lit(1))


def _total(value: Column | str, when: Column | None = None) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0)).cast("decimal(28,2)")


def population_a(cases: DataFrame, facts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row on payment cases. A false match is a confirmed case whose category isn't the true one. Explanations by a model have no precision while there are none."""
    rows = cases.select("case_id", "status", "category", "batch_id").join(facts.select("case_id", "expected_gross", "expected_net"), "case_id", "left").join(labels.select("case_id", "true_category"), "case_id", "left")
    sure = F.col("status") == "CONFIRMED"
    wrong = sure & ~F.col("category").eqNullSafe(F.col("true_category"))
    traced = F.col("batch_id").isNotNull()
    return rows.agg(
        _n().alias("case_count"), F.count_if(sure).alias("confirmed_case_count"), F.count_if(~sure).alias("deterministic_residual_count"), rate(F.count_if(sure), _n()).alias("case_match_rate"), rate(F.count_if(~sure), _n()).alias("residual_abstention_rate"),
        rate(F.count_if(wrong), F.count_if(sure)).alias("residual_false_match_rate"), F.lit(None).cast("decimal(18,6)").alias("residual_explanation_precision"),
        _total("expected_gross").alias("gross_total"), _total("expected_gross", sure).alias("gross_matched"), rate(_total("expected_gross", sure), _total("expected_gross")).alias("gross_match_rate"), _total("expected_gross", wrong).alias("gross_false_match_value"),
        _total("expected_net", sure).alias("net_reconciled"), _total("expected_net", ~sure).alias("net_unresolved"), rate(F.count_if(traced), _n()).alias("evidence_coverage"),
    )


def population_b(links: DataFrame, labels: DataFrame, defects: DataFrame) -> DataFrame:
    """One row on batches. A false link goes to another credit than the true one. Noise is recovered where a batch with a true category is linked to its credit; once with and once without the batches in defects (batch_id), whose label the data don't bear out."""
    known = labels.select("batch_id", "true_category", F.col("bank_txn_id").alias("true_bank")).join(defects.select("batch_id", F.lit(True).alias("defect")), "batch_id", "left")
    rows = links.join(known, "batch_id", "left")
    linked = F.col("bank_row_id").isNotNull()
    right = F.col("bank_row_id").eqNullSafe(F.col("true_bank"))
    wrong, open_, noisy = linked & ~right, F.col("status") == "OPEN", F.col("true_category").isNotNull()
    kept, value = F.col("defect").isNull(), "batch_net_total"
    recovered = noisy & linked & right
    named = open_ & F.col("category").eqNullSafe(F.col("true_category"))
    return rows.agg(
        _n().alias("batch_count"), F.count_if(linked).alias("linked_count"), rate(F.count_if(linked), _n()).alias("link_rate"), F.count_if(wrong).alias("false_link_count"), rate(F.count_if(wrong), F.count_if(linked)).alias("false_link_rate"),
        _total(value, linked).alias("linked_value"), _total(value, wrong).alias("false_link_value"), _total(value).alias("total_value"), F.count_if(noisy).alias("noise_count"), F.count_if(recovered).alias("noise_recovered_count"),
        rate(F.count_if(recovered), F.count_if(noisy)).alias("recovery_rate"), rate(F.count_if(recovered & kept), F.count_if(noisy & kept)).alias("recovery_rate_without_defects"), F.count_if(open_).alias("unresolved_count"), rate(F.count_if(named), F.count_if(open_)).alias("category_precision"),
        F.sort_array(F.collect_set(F.when(noisy & ~kept, F.col("batch_id")))).alias("defects_excluded"),
    )


def population_c(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row on row variances, whose denominator is rows."""
    found = rows.join(labels.select("row_id", "true_category", F.lit(True).alias("known")), "row_id", "left")
    hit = F.coalesce(F.col("known"), F.lit(False)) & F.col("category").eqNullSafe(F.col("true_category"))
    one = found.agg(_n().alias("row_count"), F.count_if(hit).alias("matched_row_count"), _total("amount").alias("row_value"))
    both = one.crossJoin(labels.agg(_n().alias("truth_row_count")))  # one row each
    return both.select("row_count", "truth_row_count", "matched_row_count", rate(F.col("matched_row_count"), F.col("truth_row_count")).alias("recall"), rate(F.col("matched_row_count"), F.col("row_count")).alias("precision"), "row_value")


def analyst_minutes(cases: DataFrame, minutes: int, confirmed_by_model: int = 0) -> DataFrame:
    """Minutes saved by rules and by a model, never as one figure. minutes for a review is an assumption that has to be named."""
    if isinstance(minutes, bool) or not isinstance(minutes, int) or minutes <= 0 or confirmed_by_model < 0:
        raise ValueError("minutes must be a positive whole number, and confirmed_by_model not negative")
    by_rules = F.count_if(F.col("status") == "CONFIRMED")
    return cases.agg(F.lit(minutes).alias("minutes_per_review"), by_rules.alias("deterministic_resolutions"), (by_rules * minutes).alias("minutes_saved_deterministic"), F.lit(confirmed_by_model).alias("model_resolutions"), F.lit(confirmed_by_model * minutes).alias("minutes_saved_model"))


def cost_per_resolved(cost: Column, resolved: Column) -> Column:
    """Cost for each resolved exception, to four places; null where none was."""
    return F.bround((cost.cast("decimal(20,6)") / F.when(resolved != 0, resolved)).cast("decimal(28,8)"), 4).cast("decimal(18,4)")


def recall_at(candidates: DataFrame, labels: DataFrame, credits: DataFrame) -> DataFrame:
    """One row: credits with a true batch, those whose candidates hold it, and the share."""
    wanted = credits.select("bank_txn_id").join(labels.where("bank_txn_id is not null").select("bank_txn_id", "batch_id"), "bank_txn_id")
    seen = wanted.join(candidates.select("bank_txn_id", "batch_id", F.lit(True).alias("seen")), ["bank_txn_id", "batch_id"], "left")
    return seen.agg(_n().alias("answerable"), F.count("seen").alias("hits"), rate(F.count("seen"), _n()).alias("recall"))


def baseline(name: str, links: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: how many links a baseline makes, and how many of them are false."""
    known = links.select("batch_id", "bank_txn_id").join(labels.select("batch_id", F.col("bank_txn_id").alias("true_bank")), "batch_id", "left")
    return known.agg(F.lit(name).alias("baseline"), _n().alias("linked"), F.count_if(~F.col("bank_txn_id").eqNullSafe(F.col("true_bank"))).alias("false_links"))


def eligible(exceptions: DataFrame, sendable: tuple[str, ...] = MODEL_CATEGORIES) -> DataFrame:
    """The exceptions that a model may see, the largest amounts first."""
    return exceptions.where(F.col("category").isin(*sendable)).orderBy(F.col("amount").desc(), "exception_id")


def tallies(state: DataFrame) -> DataFrame:
    """Exceptions by status and by who resolved them."""
    return state.groupBy("status", F.coalesce("resolved_by", F.lit("NONE")).alias("resolved_by")).agg(_n().alias("n"), _total("amount").alias("value"))


def current_categories(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each stored exception with what the outcomes of today say of its subject. A subject that is gone and one whose category was cleared stay apart by present."""
    now = outcomes.select("exception_id", F.col("category").alias("current_category"), F.col("status").alias("current_status"), F.lit(True).alias("present"))
    return state.join(now, "exception_id", "left").select("exception_id", "population", "subject_id", "category", "current_category", "current_status", F.coalesce("present", F.lit(False)).alias("present"))


def overlaps(ids: dict[str, DataFrame]) -> DataFrame:
    """For each two kinds of ids (frames of one column) how many they have in common."""
    named = [(name, frame.toDF("id").distinct()) for name, frame in sorted(ids.items())]
    out = [a.intersect(b).agg(F.lit(x).alias("a"), F.lit(y).alias("b"), _n().alias("common")) for i, (x, a) in enumerate(named) for y, b in named[i + 1 :]]
    total = out[0]
    for frame in out[1:]:
        total = total.unionByName(frame)
    return total


def duplicate_pairs(candidates: DataFrame) -> DataFrame:
    """One exception for each group of likely duplicates (order_ids, gross), as the decision is about the group."""
    return candidates.select(F.concat(F.lit("dup-"), F.array_join("order_ids", "-")).alias("exception_id"), F.lit("DUPLICATE_CANDIDATE").alias("category"), F.col("gross").alias("amount"), F.lit("OPEN").alias("status"), F.col("order_ids").alias("evidence_row_ids"))


def reference_tokens(bank: DataFrame) -> DataFrame:
    """Words of a narration that are a whole reference as they stand: 16 capitals or digits."""
    words = bank.select("bank_txn_id", F.explode(F.split("narration", r"[ /-]")).alias("token"))
    return words.where(F.col("token").rlike("^[A-Z0-9]{16}$")).distinct()


def by_stage(timings: DataFrame) -> DataFrame:
    """The median seconds of each stage over its repetitions. timings: stage, repetition, seconds."""
    return timings.groupBy("stage").agg(F.median("seconds").alias("seconds"), F.count_distinct("repetition").alias("repetitions"))


def over_seeds(figures: DataFrame, value: str) -> DataFrame:
    """One row over seeds: sum, mean, least, most, sample deviation, the square root of the mean that chance alone would give, and seeds with any."""
    v = F.col(value)
    return figures.agg(F.count_distinct("seed").alias("seeds"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_samp(v).alias("deviation"), F.sqrt(F.avg(v)).alias("by_chance"), F.count_if(v > 0).alias("seeds_with_any"))
