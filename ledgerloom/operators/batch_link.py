"""Batches against bank credits: exact, within tolerance, fuzzy, and what is left.

References in narrations are matched by equi-joins on tokens, never by a
containment join. The passes go in order of ids: batches claim credits, and in
the fuzzy pass each credit in its turn takes a batch from those that are left.
Claims are settled component by component, the fuzzy pass in rounds of joins
over what still changes; no task goes through all rows.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import LEAST_FRAGMENT, UTR_LENGTH, common_prefix, narration, utr_candidates
from ledgerloom.operators import duplicates
from ledgerloom.operators.calendar import add_working_days
from ledgerloom.operators.stage import kept, numbered

TOLERANCE, DATE_WINDOW = Decimal("1.00"), 3
#: Weights and bars of the two ways to score a credit against a batch, and the lead that the best needs.
PREFIX_WEIGHT, EDIT_WEIGHT, AMOUNT_WEIGHT, BAR_A = Decimal("0.50"), Decimal("0.30"), Decimal("0.20"), Decimal("0.85")
AMOUNT_WEIGHT_B, DATE_WEIGHT_B, BAR_B, SEPARATION = Decimal("0.60"), Decimal("0.40"), Decimal("0.90"), Decimal("0.15")


def _tolerance() -> Column:
    return F.lit(str(TOLERANCE)).cast("decimal(18,2)")


def batches_due(batches: DataFrame, profiles: DataFrame, cycles: DataFrame, days: DataFrame) -> DataFrame:
    """batches with profile and due, the day on which the bank owes the credit; without a profile the day of settlement."""
    rows = batches.join(profiles, "batch_id", "left").join(F.broadcast(cycles), "profile", "left")
    dated = add_working_days(rows, days, "settled_event_date", F.col("cycle").cast("long"), "due")
    return dated.withColumn("due", F.coalesce("due", "settled_event_date")).drop("cycle")


def credits_of(bank: DataFrame) -> DataFrame:
    return bank.where("direction = 'credit'").withColumn("words", narration(F.col("narration")))


def reference_pairs(batches: DataFrame, credits: DataFrame) -> DataFrame:
    """Batches and credits whose narration, read without blanks between its words, holds the batch's whole reference in a word."""
    tokens = credits.select("*", F.explode(F.split("words", " ")).alias("_word")).where(F.length("_word") >= UTR_LENGTH)
    starts = tokens.select("*", F.explode(F.sequence(F.lit(1), F.length("_word") - UTR_LENGTH + 1)).alias("_i"))
    grams = starts.withColumn("utr", F.substring(F.col("_word"), F.col("_i"), F.lit(UTR_LENGTH))).drop("_word", "_i").distinct()
    return batches.join(grams, "utr")


#: Batches of one component that are settled together, and the most credits that each of them then has to choose from.
FOLDED = 256


def components(pairs: DataFrame) -> DataFrame:
    """batch_id and component, the least batch that it is tied to by credits that both want. Least ids spread over two pairs and jump to what their own least id has, so long chains take few rounds."""
    label = kept(pairs.groupBy("bank_txn_id").agg(F.min("batch_id").alias("component")).join(pairs, "bank_txn_id").groupBy("batch_id").agg(F.min("component").alias("component")))
    while True:
        near = pairs.join(label, "batch_id").groupBy("bank_txn_id").agg(F.min("component").alias("near"))
        spread = pairs.join(near, "bank_txn_id").groupBy("batch_id").agg(F.min("near").alias("near")).join(label, "batch_id")
        jump = label.select(F.col("batch_id").alias("near"), F.col("component").alias("far"))
        now = kept(spread.join(jump, "near", "left").select("batch_id", F.least("near", "far").alias("component"), (F.least("near", "far") != F.col("component")).alias("moved")))
        label = now.drop("moved")
        if now.where("moved").isEmpty():
            return label


def _folded(rows: DataFrame, preference: tuple[str, ...]) -> DataFrame:
    """Links of each component's rows: its batches in order, each taking the first of its credits that is free."""
    link = "struct<batch_id:string,bank_txn_id:string>"
    begin = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast(f"array<{link}>").alias("links"))

    def step(state: Column, pair: Column) -> Column:
        settled = F.coalesce(F.get(state["links"], F.size(state["links"]) - 1)["batch_id"] == pair["batch_id"], F.lit(False))
        free = ~settled & ~F.array_contains(state["taken"], pair["bank_txn_id"])
        more = F.struct(F.concat(state["taken"], F.array(pair["bank_txn_id"])).alias("taken"), F.concat(state["links"], F.array(F.struct(pair["batch_id"], pair["bank_txn_id"]))).alias("links"))
        return F.when(free, more).otherwise(state)

    ordered = F.sort_array(F.collect_list(F.struct("batch_id", *preference, "bank_txn_id")))  # FOLDED batches with FOLDED credits at most
    return rows.groupBy("component").agg(F.aggregate(ordered, begin, step, lambda s: s["links"]).alias("links")).select(F.inline("links"))


def claim(pairs: DataFrame, *preference: str) -> DataFrame:
    """pairs (batch_id, bank_txn_id): each batch, in order, takes the credit that it prefers (least in the columns of preference, then in id) of those that none before it took.

    Batches that want none of another's credits take theirs at once. The
    others fall into components, which are settled side by side: the first
    FOLDED batches of each in one fold, for which each needs no more than its
    FOLDED best credits, then the next ones without what is taken. So the
    number of jobs depends on the largest component's size in folds, not on
    how many batches compete.
    """
    pairs = pairs.select("batch_id", "bank_txn_id", *preference).distinct()
    least = F.min_by("bank_txn_id", F.struct(*preference, "bank_txn_id")).alias("bank_txn_id")
    per_credit = pairs.groupBy("bank_txn_id").agg(F.count_distinct("batch_id").alias("n"))
    shared = pairs.join(per_credit.where("n > 1"), "bank_txn_id", "left_semi").select("batch_id").distinct()
    simple = pairs.join(shared, "batch_id", "left_anti").groupBy("batch_id").agg(least)
    wanted = kept(pairs.join(shared, "batch_id", "left_semi"))
    if wanted.isEmpty():
        return simple
    tied = kept(numbered(components(wanted), ["component", "batch_id"], "place"))
    starts = tied.groupBy("component").agg(F.min("place").alias("first"))
    turns = tied.join(starts, "component").select("batch_id", "component", F.floor((F.col("place") - F.col("first")) / FOLDED).alias("turn"))
    left, links = kept(wanted.join(turns, "batch_id")), []
    last = left.agg(F.max("turn")).first()[0]
    for turn in range(last + 1):
        best = F.row_number().over(Window.partitionBy("batch_id").orderBy(*preference, "bank_txn_id"))
        now = left.where(F.col("turn") == turn).withColumn("n", best).where(F.col("n") <= FOLDED)
        links.append(kept(_folded(now, preference)))
        if turn < last:
            left = kept(left.where(F.col("turn") > turn).join(links[-1].select("bank_txn_id"), "bank_txn_id", "left_anti"))
    return reduce(DataFrame.unionByName, [simple, *links])


def exact_links(due: DataFrame, credits: DataFrame) -> DataFrame:
    """Whole reference, equal amount, and a value date with no working day between it and the due day."""
    found = reference_pairs(due, credits)
    return claim(found.where((F.col("amount") == F.col("net_total")) & (F.col("value_date") == F.col("due"))).select("batch_id", "bank_txn_id"))


def near_links(due: DataFrame, credits: DataFrame) -> DataFrame:
    """Whole reference and an amount within the tolerance, on any day."""
    found = reference_pairs(due, credits)
    return claim(found.where(F.abs(F.col("amount") - F.col("net_total")) <= _tolerance()).select("batch_id", "bank_txn_id"))


def _still_open(batches: DataFrame, taken: DataFrame) -> DataFrame:
    """batches with taker, the credit that takes each; it is there for credits up to that one."""
    return batches.join(taken.select("batch_id", F.col("bank_txn_id").alias("taker")), "batch_id", "left")


def _in_time() -> Column:
    return F.col("taker").isNull() | (F.col("bank_txn_id") <= F.col("taker"))


def fragments(batches: DataFrame, credits: DataFrame) -> DataFrame:
    """bank_txn_id and fragment: the credit's token that begins for the longest stretch like the reference of any batch that is there in its turn. Credits without one are left out."""
    tokens = credits.select("bank_txn_id", F.posexplode(utr_candidates(F.col("narration"))).alias("rank", "token")).withColumn("head", F.substring("token", 1, LEAST_FRAGMENT))
    heads = batches.select(F.col("utr").alias("u"), "taker", F.substring("utr", 1, LEAST_FRAGMENT).alias("head"))
    shared = tokens.join(heads, "head").where(_in_time()).withColumn("length", common_prefix(F.col("token"), F.col("u")))
    return shared.groupBy("bank_txn_id").agg(F.max_by("token", F.struct("length", -F.col("rank"))).alias("fragment"))


def _scored(pairs: DataFrame) -> DataFrame:
    """pairs of a credit and a batch within the window of days, with path and score. With a fragment the score weighs prefix, edit distance and amount, without one amount and date."""
    agrees = F.when(F.abs(F.col("amount") - F.col("net_total")) <= _tolerance(), F.lit(1)).otherwise(0).cast("decimal(3,0)")
    n = F.length("fragment")
    ratio = lambda x: x.cast("decimal(20,10)") / n.cast("decimal(20,10)")
    lit = lambda x: F.lit(str(x)).cast("decimal(4,2)")
    a = lit(PREFIX_WEIGHT) * ratio(common_prefix(F.col("fragment"), F.col("utr"))) + lit(EDIT_WEIGHT) * (1 - ratio(F.levenshtein("fragment", F.expr("substring(utr, 1, length(fragment))")))) + lit(AMOUNT_WEIGHT) * agrees
    gap = F.abs(F.datediff("value_date", "due"))
    near = F.bround((F.lit(DATE_WINDOW) - gap).cast("decimal(20,10)") / F.lit(DATE_WINDOW).cast("decimal(20,10)"), 6)
    b = lit(AMOUNT_WEIGHT_B) * agrees + lit(DATE_WEIGHT_B) * near
    has = F.col("fragment").isNotNull()
    return pairs.select("bank_txn_id", "batch_id", "fragment", F.when(has, "A").otherwise("B").alias("path"), F.bround(F.when(has, a).otherwise(b), 6).cast("decimal(9,6)").alias("score"))


def no_links(frame: DataFrame) -> DataFrame:
    return frame.sparkSession.createDataFrame([], "batch_id string, bank_txn_id string")


def candidate_scores(open_batches: DataFrame, credits: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Each credit against each batch that is there in its turn and due within the window of its date: fragment, path and score. taken (batch_id, bank_txn_id): what the pass links; without it every credit comes first."""
    batches = _still_open(open_batches, no_links(credits) if taken is None else taken)
    dated = batches.withColumn("value_date", F.explode(F.expr(f"sequence(date_sub(due, {DATE_WINDOW}), date_add(due, {DATE_WINDOW}))")))
    pairs = credits.select("bank_txn_id", "value_date", "amount").join(dated, "value_date").where(_in_time())
    return _scored(pairs.join(fragments(batches, credits), "bank_txn_id", "left"))


def contenders(open_batches: DataFrame, credits: DataFrame, taken: DataFrame) -> DataFrame:
    """Scores among which each credit's best two are.

    Without a fragment only amount and date count, and all batches of a day
    whose amounts differ score alike. So a credit is held against those whose
    amounts agree, and of each day against two that are there in its turn: a
    day's batches stand in the order in which they are taken, those that never
    are first, so the ones that are there begin the list for every credit. A
    credit with a fragment is held against all batches of its days, as edits
    may make any of them the second best.
    """
    batches = _still_open(open_batches, taken)
    found = credits.select("bank_txn_id", "value_date", "amount").join(fragments(batches, credits), "bank_txn_id", "left")
    days = lambda c: F.explode(F.sequence(F.date_sub(c, DATE_WINDOW), F.date_add(c, DATE_WINDOW)))
    last_taken = Window.partitionBy("due").orderBy(F.col("taker").isNotNull(), F.col("taker").desc(), "batch_id")
    first = batches.withColumn("_n", F.row_number().over(last_taken)).where(F.col("_n") <= 2).drop("_n")
    whole = found.where("fragment is null")
    near = whole.withColumn("due", days("value_date")).join(first, "due")
    pairs = near.unionByName(_agreeing(whole, batches)).dropDuplicates(["bank_txn_id", "batch_id"])
    cut = found.where("fragment is not null").withColumn("due", days("value_date")).join(batches, "due")
    return _scored(pairs.unionByName(cut).where(_in_time() & (F.abs(F.datediff("value_date", "due")) <= DATE_WINDOW)))


def _agreeing(credits: DataFrame, batches: DataFrame) -> DataFrame:
    """Pairs whose amounts are within the tolerance: equal whole units, or the next ones."""
    units = batches.withColumn("unit", F.explode(F.array(*[F.floor("net_total") + i for i in (-1, 0, 1)])))
    return credits.withColumn("unit", F.floor("amount")).join(units, "unit").where(F.abs(F.col("amount") - F.col("net_total")) <= _tolerance()).drop("unit")


#: Characters of a fragment and a reference that agree wherever a score can decide: a runner-up within the separation of a score over
#: the bar has 0.70 at least, of which edits and amount give 0.50, so two fifths of a fragment of six characters or more.
DECISIVE_PREFIX = 3


def _accepted(open_batches: DataFrame, credits: DataFrame, taken: DataFrame) -> DataFrame:
    """Links of all credits, each against what is there in its turn. Only pairs that can decide are scored: a long enough prefix, or without a fragment an amount that agrees."""
    batches = _still_open(open_batches, taken)
    found = credits.select("bank_txn_id", "value_date", "amount").join(fragments(batches, credits), "bank_txn_id", "left")
    head = lambda c: F.substring(c, 1, DECISIVE_PREFIX)
    by_prefix = found.where("fragment is not null").withColumn("head", head("fragment")).join(batches.withColumn("head", head("utr")), "head")
    by_amount = _agreeing(found.where("fragment is null"), batches)
    pairs = by_prefix.drop("head").unionByName(by_amount).where(_in_time() & (F.abs(F.datediff("value_date", "due")) <= DATE_WINDOW))
    best = _ranked(_scored(pairs)).where(_clear(F.col("score"), F.col("next"), F.col("path")))
    return best.groupBy("batch_id").agg(F.min("bank_txn_id").alias("bank_txn_id"))


def _ranked(scores: DataFrame) -> DataFrame:
    """Each credit's best batch, with next, the score of the second best."""
    by = Window.partitionBy("bank_txn_id").orderBy(F.col("score").desc(), "batch_id")
    return scores.withColumn("n", F.row_number().over(by)).withColumn("next", F.lead("score").over(by)).where("n = 1").drop("n")


def _clear(score: Column, runner_up: Column, path: Column) -> Column:
    """Whether the best score is over its path's bar and far enough before the runner-up."""
    bar = F.when(path == "A", F.lit(str(BAR_A))).otherwise(F.lit(str(BAR_B))).cast("decimal(9,6)")
    return (score >= bar) & (score - F.coalesce(runner_up, F.lit(0)) >= F.lit(str(SEPARATION)).cast("decimal(9,6)"))


def fuzzy_links(open_batches: DataFrame, credits: DataFrame) -> DataFrame:
    """The pass over what the exact passes left: credits in order of their ids, an accepted batch is gone for those after it.

    A credit's verdict depends on the links of those before it only. So all
    verdicts are taken at once, given the links of the round before, until a
    round changes nothing. After each round the verdicts of one more credit of
    every chain are final, so there are as many rounds as the longest chain of
    credits has links, each of which changes what is there for the next.
    """
    taken = no_links(credits)
    while True:
        now = kept(_accepted(open_batches, credits, taken))
        both = now.withColumn("side", F.lit(1)).unionByName(taken.withColumn("side", F.lit(-1)))
        if both.groupBy("batch_id", "bank_txn_id").agg(F.sum("side").alias("n")).where("n <> 0").isEmpty():
            return now
        taken = now


def verdicts(open_batches: DataFrame, credits: DataFrame, taken: DataFrame) -> DataFrame:
    """The verdict on each credit in its turn: accepted, ambiguous or abstained. A batch beyond the window of days scores 0; credits that come when no batch is left have no verdict. taken: the links of ``fuzzy_links``."""
    n_open, n_taken = open_batches.count(), taken.count()
    last = [r[0] for r in taken.select("bank_txn_id").orderBy(F.desc("bank_txn_id")).limit(2).collect()]
    turn, never = F.col("bank_txn_id"), F.lit(False)
    if n_open == 0:
        none_left, one_left = ~never, never
    elif n_open == n_taken:
        none_left, one_left = turn > last[0], (turn > last[1]) if n_open > 1 else ~never
    else:
        none_left, one_left = never, (turn > last[0] if n_taken else ~never) if n_open == n_taken + 1 else never
    best = _ranked(contenders(open_batches, credits, taken))
    rows = credits.select("bank_txn_id").where(~none_left).join(fragments(_still_open(open_batches, taken), credits).select("bank_txn_id", F.lit("A").alias("_path")), "bank_txn_id", "left").join(best.drop("path", "fragment"), "bank_txn_id", "left")
    zero = F.lit(0).cast("decimal(9,6)")
    rows = rows.select("bank_txn_id", "batch_id", F.coalesce("_path", F.lit("B")).alias("path"), F.coalesce("score", zero).alias("best_score"), F.when(~one_left, F.coalesce("next", zero)).alias("runner_up_score"))
    outcome = (
        F.when((F.col("best_score") <= 0) | F.coalesce(F.col("best_score") == F.col("runner_up_score"), F.lit(False)), "ABSTAINED")
        .when(_clear(F.col("best_score"), F.col("runner_up_score"), F.col("path")), "ACCEPTED").otherwise("AMBIGUOUS")
    )
    return rows.select("bank_txn_id", outcome.alias("outcome"), "path", F.when(outcome == "ACCEPTED", F.col("batch_id")).alias("matched_batch_id"), "best_score", "runner_up_score")


def naive_links(batches: DataFrame, credits: DataFrame, as_of: Column, window: int = 5) -> DataFrame:
    """Amount and date alone: batches in order take the credit with the nearest date, then amount."""
    pairs = _amount_seen(batches, credits).join(batches.select("batch_id", "net_total", "settled_event_date"), "batch_id").join(credits.select("bank_txn_id", "amount", "value_date"), "bank_txn_id")
    near = pairs.select("batch_id", "bank_txn_id", F.abs(F.datediff("settled_event_date", "value_date")).alias("gap"), F.abs(F.col("amount") - F.col("net_total")).alias("off"), "value_date")
    return claim(near.where((F.col("gap") <= window) & (F.col("value_date") <= as_of)), "gap", "off")


def _running_count(rows: DataFrame) -> DataFrame:
    """rows (v, side) with seen, how many rows of side 1 are there up to each in order of v and side. Ranges are counted on their own and moved on by what lies before; only one row for each range is added up in one place."""
    n_ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(rows.repartitionByRange(n_ranges, "v", "side").withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.sum("side").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    here = F.sum("side").over(Window.partitionBy("range").orderBy("v", "side").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("here", here).join(F.broadcast(before), "range").select("v", "side", (F.col("here") + F.col("before")).alias("seen"))


def nearest_batches(credits: DataFrame, batches: DataFrame, limit: int = 20) -> DataFrame:
    """bank_txn_id, batch_id and rank of the limit batches nearest in amount, then date, then id, of all batches.

    Distinct amounts of both sides are counted in order, which tells between
    which of the batches' amounts a credit's lies. The limit amounts on either
    side hold the nearest batches, and are found by an equi-join on blocks.
    """
    distinct = lambda frame, c, side: frame.select(F.col(c).alias("v")).distinct().withColumn("side", F.lit(side))
    counted = kept(_running_count(distinct(batches, "net_total", 1).unionByName(distinct(credits, "amount", 0))))
    block = lambda c: F.floor(c / limit)
    placed = counted.where("side = 0").select(F.col("v").alias("amount"), "seen", F.explode(F.sequence(block(F.col("seen") - limit + 1), block(F.col("seen") + limit))).alias("block"))
    own = counted.where("side = 1").select(F.col("v").alias("net_total"), F.col("seen").alias("place"), block(F.col("seen")).alias("block"))
    near = placed.join(own, "block").where((F.col("place") > F.col("seen") - limit) & (F.col("place") <= F.col("seen") + limit)).select("amount", "net_total")
    pairs = credits.select("bank_txn_id", "amount", "value_date").join(near, "amount").join(batches.select("batch_id", "net_total", "settled_event_date"), "net_total")
    by = Window.partitionBy("bank_txn_id").orderBy(F.abs(F.col("amount") - F.col("net_total")), F.abs(F.datediff("value_date", "settled_event_date")), "batch_id")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).select("bank_txn_id", "batch_id", "rank")


def diagnostics(due: DataFrame, credits: DataFrame, exact: DataFrame) -> DataFrame:
    """Per batch whether a credit that no batch before it claimed holds its whole reference, and whether one has its amount. exact: the claims."""
    owned = credits.join(exact.select("bank_txn_id", F.col("batch_id").alias("owner")), "bank_txn_id", "left")
    free = F.col("owner").isNull() | (F.col("owner") >= F.col("batch_id"))
    seen = reference_pairs(due, owned).where(free).select("batch_id").distinct().withColumn("utr_seen", F.lit(True))
    amounts = owned.groupBy(F.col("amount").alias("net_total")).agg(F.max("owner").alias("owner"), F.bool_or(F.col("owner").isNull()).alias("unclaimed"))
    rows = due.join(seen, "batch_id", "left").join(amounts, "net_total", "left")
    return rows.select("batch_id", F.coalesce("utr_seen", F.lit(False)).alias("utr_seen"), F.coalesce(F.col("unclaimed") | (F.col("owner") >= F.col("batch_id")), F.lit(False)).alias("amount_seen"))


def _prefix_seen(batches: DataFrame, credits: DataFrame) -> DataFrame:
    """Ids of batches and credits where a narration word holds the first characters of the reference anywhere."""
    words = credits.select("bank_txn_id", F.explode(F.split("words", " ")).alias("w")).where(F.length("w") >= LEAST_FRAGMENT)
    grams = words.select("bank_txn_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - LEAST_FRAGMENT + 1), lambda i: F.substring(F.col("w"), i, F.lit(LEAST_FRAGMENT)))).alias("head")).distinct()
    return batches.where(F.length("utr") > LEAST_FRAGMENT).select("batch_id", F.substring("utr", 1, LEAST_FRAGMENT).alias("head")).join(grams, "head").select("batch_id", "bank_txn_id").distinct()


def _amount_seen(batches: DataFrame, credits: DataFrame) -> DataFrame:
    """Ids of batches and credits whose amounts are within the tolerance: equal whole units, or the next ones."""
    left = batches.select("batch_id", "net_total", F.explode(F.array(*[F.floor("net_total") + i for i in (-1, 0, 1)])).alias("unit"))
    pairs = left.join(credits.select("bank_txn_id", "amount", F.floor("amount").alias("unit")), "unit")
    return pairs.where(F.abs(F.col("amount") - F.col("net_total")) <= _tolerance()).select("batch_id", "bank_txn_id").distinct()


class BatchPasses:
    """The passes in order, each over what those before it left."""

    def __init__(self, batches: DataFrame, bank: DataFrame, profiles: DataFrame, cycles: DataFrame, days: DataFrame, as_of: str):
        self.as_of = F.lit(as_of).cast("date")
        self.due = kept(batches_due(batches, profiles, cycles, days))
        self.credits = credits_of(bank)
        # Each pass is a small table of ids that all later ones read, so it is written once.
        self.exact = kept(exact_links(self.due, self.credits))
        left, free = self.due.join(self.exact, "batch_id", "left_anti"), self.credits.join(self.exact, "bank_txn_id", "left_anti")
        self.near = kept(near_links(left, free))
        left, self.free = left.join(self.near, "batch_id", "left_anti"), free.join(self.near, "bank_txn_id", "left_anti")
        self.pending, self.open = left.where(F.col("due") > self.as_of), left.where(F.col("due") <= self.as_of)

    @cached_property
    def fuzzy(self) -> DataFrame:
        return kept(fuzzy_links(self.open, self.free))

    def outcomes(self) -> DataFrame:
        """One row for each batch: status, bank_row_id, amounts and category."""
        fuzzy = self.fuzzy
        linked = self.exact.withColumn("how", F.lit("exact")).unionByName(self.near.withColumn("how", F.lit("near"))).unionByName(fuzzy.withColumn("how", F.lit("fuzzy")))
        rest, free = self.open.join(fuzzy, "batch_id", "left_anti"), self.free.join(fuzzy, "bank_txn_id", "left_anti")
        prefix = _prefix_seen(rest, free).select("batch_id").distinct().withColumn("prefix_seen", F.lit(True))
        amount = _amount_seen(rest, free).select("batch_id").distinct().withColumn("amount_seen", F.lit(True))
        rows = self.due.join(linked, "batch_id", "left").join(self.credits.select("bank_txn_id", "amount"), "bank_txn_id", "left").join(prefix, "batch_id", "left").join(amount, "batch_id", "left")
        variance = (F.col("net_total") - F.col("amount")).cast("decimal(18,2)")
        confirmed, waiting = F.col("how").isNotNull(), F.col("due") > self.as_of
        category = (
            F.when(confirmed & (F.abs(variance) > 0), F.when(F.abs(variance) <= _tolerance(), "ROUNDING_DIFFERENCE").otherwise("UNEXPLAINED")).when(confirmed | waiting, F.lit(None).cast("string"))
            .when(F.col("prefix_seen"), "UTR_TRUNCATED_MAPPING").when(F.col("amount_seen"), "UTR_MISSING_MAPPING").otherwise("MISSING_VS_LATE_CREDIT")
        )
        status = F.when(confirmed, "CONFIRMED").when(waiting, "PENDING_EVIDENCE").otherwise("OPEN")
        return rows.select("batch_id", status.alias("status"), F.col("bank_txn_id").alias("bank_row_id"), F.col("net_total").alias("batch_net_total"), F.col("amount").alias("linked_amount"), F.when(confirmed, variance).alias("variance"), category.alias("category"), F.when(confirmed, "DETERMINISTIC").alias("resolved_by"))

    def orphan_credits(self) -> DataFrame:
        """Credits that no pass took and that resemble no batch at all, linked or not."""
        free = self.free.join(self.fuzzy, "bank_txn_id", "left_anti")
        like = _prefix_seen(self.due, free).unionByName(reference_pairs(self.due, free).select("batch_id", "bank_txn_id")).unionByName(_amount_seen(self.due, free))
        return free.join(like.select("bank_txn_id").distinct(), "bank_txn_id", "left_anti").select("bank_txn_id", "value_date", "amount", "narration")


def row_variances(ledger: DataFrame, orphans: DataFrame) -> DataFrame:
    """Variances of single rows: confirmed duplicate orders, and credits that belong to no batch."""
    copies = duplicates.confirmed(ledger).select(F.col("order_id").alias("row_id"), F.lit("ledger_rows").alias("source_table"), F.lit("CONFIRMED").alias("status"), F.lit("DUPLICATE_CONFIRMED").alias("category"), "amount")
    return copies.unionByName(orphans.select(F.col("bank_txn_id").alias("row_id"), F.lit("bank_rows").alias("source_table"), F.lit("OPEN").alias("status"), F.lit("UNEXPLAINED").alias("category"), "amount"))
