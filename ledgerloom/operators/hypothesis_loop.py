"""Asking about exceptions until no answer is left to come.

A round asks about every exception that is open, verifies what comes back,
confirms what passes and puts the rest where it belongs: an abstention is a
result, an outage isn't, so what a service was down for is asked again in the
next round. Rounds end when nothing is left to ask, or when a round could reach
nothing new. State is a ``store``, with a commit for each round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import hypotheses as H
from ledgerloom.operators import store as S
from ledgerloom.operators.metrics import MODEL_CATEGORIES
from ledgerloom.operators.stage import kept

#: Times that one response is asked for, and who acts.
ATTEMPTS, ACTOR, VERIFIED, WAITING = 3, "AI", "AI_VERIFIED", "PENDING_AI_UNAVAILABLE"
#: Why a case that was answered, or has no recording, stays undecided.
REASONS = ("fixture_miss", "no_hypothesis", "all_rejected", "below_threshold")


def attempts(asked: DataFrame, responses: DataFrame, categories: tuple[str, ...] = MODEL_CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """What each exception (exception_id, prompt_hash) is answered, and the usable hypotheses of that answer.

    responses: prompt_hash, attempt, response, unavailable. Attempts are made
    in order; one without a usable hypothesis is followed by the next. An
    outage and a prompt without a recording end them.
    """
    tried = asked.select("exception_id", "prompt_hash", F.explode(F.array(*[F.lit(k) for k in range(1, ATTEMPTS + 1)])).alias("attempt"))
    known = responses.select("prompt_hash", "attempt", "response", F.coalesce("unavailable", F.lit(False)).alias("down"), F.lit(True).alias("known"))
    replies = kept(tried.join(known, ["prompt_hash", "attempt"], "left").drop("prompt_hash"))
    usable = kept(H.parse(replies.where(F.col("known") & ~F.col("down")).select("exception_id", "attempt", "response"), categories))
    counted = usable.groupBy("exception_id", "attempt").agg(F.count(F.lit(1)).alias("seen"))
    state = F.when(F.col("known").isNull(), "fixture_miss").when(F.col("down"), "unavailable").when(F.col("seen") > 0, "answered")
    rows = replies.select("exception_id", "attempt", "known", "down").join(counted, ["exception_id", "attempt"], "left").withColumn("reply", state)
    first = F.min(F.when(F.col("reply").isNotNull(), F.struct("attempt", "reply", F.coalesce("seen", F.lit(0)).alias("seen"))))
    answers = rows.groupBy("exception_id").agg(first.alias("a")).select("exception_id", F.coalesce("a.reply", F.lit("no_hypothesis")).alias("reply"), F.coalesce("a.attempt", F.lit(ATTEMPTS)).alias("attempt"), F.coalesce("a.seen", F.lit(0)).alias("seen"))
    answers = kept(answers)
    return answers, usable.join(answers.where("reply = 'answered'").select("exception_id", "attempt"), ["exception_id", "attempt"]).drop("attempt")


def decide(answers: DataFrame, verified: DataFrame) -> DataFrame:
    """What becomes of each exception: outcome, abstain_reason, the candidate offered first, and of the hypothesis that decides its candidate_id, score and evidence.

    Hypotheses count in order of rank: the first that passes decides, those
    before it are rejections. One that passes below the bar is an abstention.
    """
    first = F.min(F.when(F.col("passed"), F.struct("rank", "candidate_id", "score", "auto_confirm", "evidence_row_ids")))
    best = verified.groupBy("exception_id").agg(first.alias("best"), F.sort_array(F.collect_list("rank")).alias("ranks"), F.min_by("candidate_id", "rank").alias("offered"))  # three at most
    rows = answers.join(best, "exception_id", "left")
    sure, passed = F.coalesce(F.col("best.auto_confirm"), F.lit(False)), F.col("best").isNotNull()
    outcome = F.when(F.col("reply") == "unavailable", WAITING).when(sure, "CONFIRMED").otherwise("ABSTAINED")
    reason = F.when((F.col("reply") == "unavailable") | sure, F.lit(None).cast("string")).when(F.col("reply") != "answered", F.col("reply")).when(passed, "below_threshold").otherwise("all_rejected")
    rejected = F.size(F.filter(F.coalesce("ranks", F.array().cast("array<int>")), lambda r: ~passed | (r < F.col("best.rank"))))
    return rows.select("exception_id", outcome.alias("outcome"), reason.alias("abstain_reason"), "attempt", "seen", rejected.alias("rejected"), F.col("best.candidate_id").alias("candidate_id"), "offered", F.col("best.score").alias("score"), F.col("best.evidence_row_ids").alias("evidence_row_ids"))


def report(outcomes: DataFrame) -> DataFrame:
    """Per round: what was sent and what became of it, each counted and none derived; a round that doesn't add up raises. Abstentions are a share of what was answered, n/a over nothing."""
    n = lambda c: F.count_if(c).alias
    is_ = lambda o: F.col("outcome") == o
    rows = outcomes.groupBy("round").agg(F.count(F.lit(1)).alias("sent"), n(is_("CONFIRMED"))("confirmed"), n(is_("ABSTAINED"))("abstained"), n(is_(WAITING))("unavailable"), *[n(F.col("abstain_reason") == r)(r) for r in REASONS])
    whole = F.col("confirmed") + F.col("abstained") + F.col("unavailable")
    sure = F.when(whole == F.col("sent"), F.col("sent")).otherwise(F.raise_error(F.lit("outcomes don't add up to what was sent")).cast("long"))
    examined = (F.col("sent") - F.col("unavailable")).cast("decimal(20,4)")
    share = F.bround(F.col("abstained").cast("decimal(20,4)") / F.nullif(examined, F.lit(0)), 4).cast("decimal(18,4)").cast("string")
    return rows.withColumn("sent", sure).withColumn("abstention_rate", F.coalesce(share, F.lit("n/a")))


def run(store: S.Store, day: int, asked: DataFrame, responses: Callable[[int], DataFrame], verify: Callable[[DataFrame], DataFrame], most_rounds: int = 10) -> DataFrame:
    """Ask in rounds; the outcomes of all of them, with round. asked: exception_id and prompt_hash of what may be sent. responses gives what there is in a round, verify scores hypotheses.

    The store's exceptions become CONFIRMED, ABSTAINED or wait for the service.
    """
    every, number, waiting = [], 1, None
    while number <= most_rounds:
        state, resolutions, audit = (store.read(t) for t in ("exceptions", "resolutions", "audit"))
        open_ = kept(state.where(F.col("status").isin("OPEN", WAITING)).select("exception_id", "status").join(asked, "exception_id"))
        answers, usable = attempts(open_, responses(number))
        outcomes = kept(decide(answers, kept(verify(usable))).withColumn("round", F.lit(number)))
        sent, down = outcomes.agg(F.count(F.lit(1)), F.count_if(F.col("outcome") == WAITING)).first()
        if sent == 0:
            break
        every.append(outcomes)
        came = outcomes.join(open_.select("exception_id", "status"), "exception_id")
        to = lambda rows, status, note: rows.select("exception_id", F.lit(status).alias("to_status"), note.alias("note"), F.array().cast("array<string>").alias("evidence_ids"))
        state, reopened = S.mark(state, to(came.where((F.col("status") == WAITING) & (F.col("outcome") == "ABSTAINED")), "OPEN", F.lit("the service is back")), ACTOR, day)
        state, moved = S.mark(state, to(came.where(F.col("outcome") == "ABSTAINED"), "ABSTAINED", F.col("abstain_reason")).unionByName(to(came.where((F.col("outcome") == WAITING) & (F.col("status") == "OPEN")), WAITING, F.lit("the service is down"))), ACTOR, day)
        asks = outcomes.where("outcome = 'CONFIRMED'").select("exception_id", F.lit(VERIFIED).alias("resolution_type"), F.col("evidence_row_ids").alias("evidence_ids"), F.col("score").alias("confidence"))
        state, new, confirmed = S.confirm(state, resolutions, asks, day, ACTOR, VERIFIED)
        later = lambda rows, phase: rows.withColumn("phase", F.lit(phase))
        store.commit({"exceptions": state, "resolutions": new, "audit": S.sequenced([later(reopened, 0), later(moved, 1), later(confirmed, 2)], audit, day)})
        if down == 0 or (down == sent and waiting == down):
            break
        waiting, number = down, number + 1
    return reduce(DataFrame.unionByName, every) if every else outcomes
