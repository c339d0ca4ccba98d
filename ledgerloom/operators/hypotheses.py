"""Hypotheses about exceptions: parsed, verified against the rows they cite, scored.

Responses come from a table keyed by the hash of the prompt, so a run is
repeatable and needs no network.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the confidence, the bar for automatic confirmation, the verifier's tolerance, the most hypotheses read of a response.
WEIGHTS = {"passed": "0.40", "within": "0.20", "completeness": "0.20", "separation": "0.15", "fresh": "0.05"}
AUTO_CONFIRM, TOLERANCE, MOST = "0.80", "1.00", 3
OPERATORS = ("==", "<=", ">=", "<", ">")


def _number(text: str) -> Column:
    return F.lit(text).cast("decimal(6,4)")


def prompts(exceptions: DataFrame, evidence: DataFrame) -> DataFrame:
    """exceptions with the prompt over their evidence (exception_id, row_id, detail), in order, and its hash."""
    listed = evidence.groupBy("exception_id").agg(F.sort_array(F.collect_list(F.struct("row_id", "detail"))).alias("rows"))
    lines = F.array_join(F.transform("rows", lambda r: F.concat_ws(" ", r["row_id"], r["detail"])), "\n")
    text = F.concat_ws("\n", F.format_string("Exception %s of category %s over %s", "exception_id", F.coalesce("category", F.lit("none")), F.col("amount").cast("string")), lines)
    return exceptions.join(listed, "exception_id", "left").withColumn("prompt", text).drop("rows").withColumn("prompt_hash", F.sha2("prompt", 256))


def replay(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """asked with the response to each prompt and what became of it: answered, unavailable (an outage) or fixture_miss (no such prompt)."""
    known = responses.select("prompt_hash", "response", F.coalesce("unavailable", F.lit(False)).alias("unavailable"), F.lit(True).alias("known"))
    return asked.join(known, "prompt_hash", "left").withColumn("reply", F.when(F.col("known").isNull(), "fixture_miss").when(F.col("unavailable"), "unavailable").otherwise("answered")).drop("known", "unavailable")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _at(value: str, path: str) -> Column:
    return F.try_variant_get(F.col(value), path, "variant")


def validate(replies: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """A row for each of the first hypotheses of a response, and one for a response without any: rank, h (as it stands) and faults, what the schema says against it, by path.

    A response has to be an object with an array ``hypotheses`` of objects;
    category is one of categories, candidate_id and reason are texts,
    evidence_row_ids an array of texts, and residual_amount, where it is
    there, a text or whole number that is exact. Nothing is put right.
    """
    body = F.regexp_replace(F.regexp_replace("response", r"(?s)^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    read = replies.withColumn("_v", F.try_parse_json(body)).withColumn("_list", F.try_variant_get("_v", "$.hypotheses", "array<variant>"))
    rest = replies.drop("response").columns
    whole = F.when(F.col("_v").isNull(), "$: not JSON").when(~_kind(F.col("_v")).startswith("OBJECT"), "$: not an object").when(F.col("_list").isNull(), "$.hypotheses: not an array").when(F.size("_list") == 0, "$.hypotheses: empty")
    rows = read.withColumn("_whole", whole).select(*rest, "_whole", F.posexplode_outer(F.slice("_list", 1, MOST)).alias("rank", "h"))
    residual, evidence = _at("h", "$.residual_amount"), F.try_variant_get("h", "$.evidence_row_ids", "array<variant>")
    exact = F.try_variant_get("h", "$.residual_amount", "string").rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$")
    is_text = lambda path: F.coalesce(_kind(_at("h", path)) == "STRING", F.lit(False))
    wrong = {
        "category": ~is_text("$.category") | ~F.coalesce(F.try_variant_get("h", "$.category", "string").isin(*categories), F.lit(False)),
        "candidate_id": ~is_text("$.candidate_id"), "reason": ~is_text("$.reason"),
        "evidence_row_ids": F.coalesce(~F.forall(evidence, lambda x: F.coalesce(_kind(x) == "STRING", F.lit(False))), F.lit(True)),
        "residual_amount": F.coalesce((_kind(residual) != "VOID") & ~((_kind(residual).isin("STRING", "BIGINT")) & exact), F.lit(False)),
    }
    path = lambda name: F.concat(F.lit("$.hypotheses["), F.col("rank").cast("string"), F.lit("]"), F.lit(f".{name}" if name else ""))
    is_object = F.coalesce(_kind(F.col("h")).startswith("OBJECT"), F.lit(False))
    each = F.when(is_object, F.array_compact(F.array(*[F.when(w, path(name)) for name, w in wrong.items()]))).otherwise(F.array(path("")))
    return rows.select(*rest, "rank", "h", F.when(F.col("_whole").isNotNull(), F.array("_whole")).otherwise(each).alias("faults"))


def parse(replies: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """A row for each usable hypothesis: its rank in the response counts, at most the first ones are read, invalid ones are dropped. An assertion of another shape is none."""
    text = lambda p: F.try_variant_get("h", p, "string")
    sides = [text(f"$.assertion.{c}").alias(c) for c in ("lhs", "op", "rhs")]
    whole = F.when(sides[0].isNotNull() & sides[1].isNotNull() & sides[2].isNotNull(), F.struct(*sides))
    more = [c for c in ("attempt",) if c in replies.columns]
    return validate(replies, categories).where(F.size("faults") == 0).select(
        "exception_id", *more, "rank", text("$.category").alias("category"), text("$.candidate_id").alias("candidate_id"), whole.alias("assertion"), F.trim(text("$.residual_amount")).try_cast("decimal(18,2)").alias("residual_amount"),
        F.sort_array(F.try_variant_get("h", "$.evidence_row_ids", "array<string>")).alias("evidence_row_ids"), text("$.reason").alias("reason"),
    )


def parse_links(replies: DataFrame) -> DataFrame:
    """A row for each item of responses ``{"links": [...]}``: bank_txn_id, batch_id (null: the model abstains), confidence and failed. A response of another shape is one failed row."""
    body = F.regexp_replace(F.regexp_replace("response", r"(?s)^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    read = replies.withColumn("_v", F.try_parse_json(body)).withColumn("_list", F.coalesce(F.try_variant_get("_v", "$.links", "array<variant>"), F.try_variant_get("_v", "$", "array<variant>")))
    rest = replies.drop("response").columns
    rows = read.withColumn("_broken", F.col("_list").isNull()).select(*rest, "_broken", F.explode_outer("_list").alias("h"))
    number = F.coalesce(F.try_variant_get("h", "$.confidence", "string"), F.lit("0")).try_cast("decimal(9,6)")
    batch = F.nullif(F.nullif(F.try_variant_get("h", "$.batch_id", "string"), F.lit("")), F.lit("null"))
    bank = F.try_variant_get("h", "$.bank_txn_id", "string")
    failed = F.col("_broken") | bank.isNull() | number.isNull()
    return rows.where(F.col("_broken") | F.col("h").isNotNull()).select(*rest, F.when(~failed, bank).alias("bank_txn_id"), F.when(~failed, batch).alias("batch_id"), F.when(~failed, number).alias("confidence"), failed.alias("failed"))


def row_index(tables: dict[str, tuple[DataFrame, str]], cited: DataFrame | None = None, money: tuple[str, ...] = ("gross", "authorized", "captured", "amount", "fee", "tax", "net", "net_total")) -> DataFrame:
    """row_id, tab and fields (the money columns by name) over all tables (name: frame and id column); of the rows that are cited (row_id) alone, where those are given."""
    asked = None if cited is None else cited.select("row_id").distinct()

    def one(name: str, frame: DataFrame, key: str) -> DataFrame:
        if asked is not None:
            frame = frame.join(asked.withColumnRenamed("row_id", key), key, "left_semi")
        here = [c for c in money if c in frame.columns]
        fields = F.map_from_arrays(F.array(*[F.lit(f"{name}.{c}") for c in here]), F.array(*[F.col(c).cast("decimal(18,2)") for c in here]))
        return frame.select(F.col(key).alias("row_id"), F.lit(name).alias("tab"), fields.alias("fields")).dropDuplicates(["row_id"])

    return reduce(DataFrame.unionByName, [one(n, f, k) for n, (f, k) in tables.items()])


def verify(hypotheses: DataFrame, index: DataFrame, ledger: DataFrame, chains: DataFrame) -> DataFrame:
    """hypotheses with passed, computed_residual, reason_failed, completeness and separation.

    All cited rows must exist. A claim of a duplicate order is checked by
    structure: two orders of one customer over one amount, of which the
    nominated one has the shorter settlement chain. Any other claim is
    arithmetic: its assertion over money fields of the cited rows must hold.
    """
    key = ["exception_id", "rank"]
    cited = hypotheses.select(*key, F.explode_outer("evidence_row_ids").alias("row_id"))
    resolved = cited.join(index, "row_id", "left")
    got = resolved.groupBy(*key).agg(F.count("row_id").alias("n_cited"), F.count("tab").alias("n_found"), F.collect_list(F.when(F.col("tab").isNotNull(), F.struct("tab", "row_id", "fields"))).alias("found"))
    fields = F.aggregate(F.sort_array(F.transform("found", lambda x: F.struct(x["tab"].alias("tab"), x["row_id"].alias("row_id"), F.map_entries(x["fields"]).alias("fields")))), F.array().cast("array<struct<key:string,value:decimal(18,2)>>"), lambda acc, x: F.concat(F.filter(acc, lambda e: ~F.exists(x["fields"], lambda y: y["key"] == e["key"])), x["fields"]))
    got = got.withColumn("fields", F.map_from_entries(fields))
    pair = cited.join(ledger.dropDuplicates(["order_id"]).select(F.col("order_id").alias("row_id"), "customer_id", "gross"), "row_id").join(chains.select(F.col("order_id").alias("row_id"), "chain_length"), "row_id", "left")
    pair = pair.groupBy(*key).agg(F.count(F.lit(1)).alias("n_orders"), F.count_distinct("customer_id", "gross").alias("n_kinds"), F.map_from_entries(F.collect_list(F.struct("row_id", F.coalesce("chain_length", F.lit(0))))).alias("lengths"))
    rows = hypotheses.join(got, key, "left").join(pair, key, "left")
    mine = F.try_element_at("lengths", F.col("candidate_id"))
    other = F.aggregate(F.filter(F.map_entries("lengths"), lambda e: e["key"] != F.col("candidate_id")), F.lit(None).cast("long"), lambda a, e: e["value"])
    side = lambda c: F.coalesce(F.try_element_at("fields", F.col(c)), F.expr(f"try_cast({c} AS decimal(18,2))"))
    lhs, rhs = side("assertion.lhs"), side("assertion.rhs")
    residual = (lhs - rhs).cast("decimal(18,2)")
    op, tolerance = F.col("assertion.op"), F.lit(TOLERANCE).cast("decimal(18,2)")
    holds = F.when(op == "==", F.abs(residual) <= tolerance).when(op == "<=", lhs <= rhs).when(op == ">=", lhs >= rhs).when(op == "<", lhs < rhs).when(op == ">", lhs > rhs)
    structural = F.col("category") == "DUPLICATE_CANDIDATE"
    failed = (
        F.when(F.col("n_cited") == 0, "no evidence").when(F.col("n_found") < F.col("n_cited"), "missing evidence")
        .when(structural, F.when((F.coalesce("n_orders", F.lit(0)) != 2) | (F.col("n_cited") != 2), "not two orders").when(F.col("n_kinds") != 1, "different orders").when(mine.isNull(), "nominee not cited").when(mine >= other, "chains don't tell them apart"))
        .when(op.isNull() | ~op.isin(*OPERATORS), "no assertion").when(lhs.isNull() | rhs.isNull(), "unknown field").when(~holds, "assertion fails")
    )
    return rows.select(
        *hypotheses.columns, failed.isNull().alias("passed"), F.when(~structural, residual).when(failed.isNull(), F.lit(0).cast("decimal(18,2)")).alias("computed_residual"), failed.alias("reason_failed"),
        F.coalesce(F.col("n_found").cast("decimal(9,4)") / F.nullif(F.col("n_cited").cast("decimal(9,4)"), F.lit(0)), F.lit(0)).cast("decimal(6,4)").alias("completeness"),
        F.when(failed.isNull(), F.lit(1)).otherwise(0).cast("decimal(6,4)").alias("separation"),
    )


def confidence(verified: DataFrame, fresh: bool = True) -> DataFrame:
    """verified with score, of four places, and auto_confirm, which needs a passed verification and the score."""
    clip = lambda c: F.least(F.lit(1), F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))).cast("decimal(6,4)")
    flag = lambda c: F.when(c, F.lit(1)).otherwise(0).cast("decimal(6,4)")
    terms = {"passed": flag(F.col("passed")), "within": flag(F.abs("computed_residual") <= F.lit(TOLERANCE).cast("decimal(18,2)")), "completeness": clip(F.col("completeness")), "separation": clip(F.col("separation")), "fresh": flag(F.lit(fresh))}
    score = F.round(reduce(lambda a, b: a + b, [_number(WEIGHTS[k]) * t for k, t in terms.items()]), 4).cast("decimal(5,4)")
    return verified.withColumn("score", score).withColumn("auto_confirm", F.col("passed") & (F.col("score") >= _number(AUTO_CONFIRM)))


def pairs(residual: DataFrame, orders: DataFrame) -> DataFrame:
    """Two residual duplicate candidates of one amount and batch make a pair; groups of another size stay apart: amount, batch_id, order_ids."""
    rows = residual.where("category = 'DUPLICATE_CANDIDATE'").join(orders, "case_id")
    return rows.groupBy("amount", "batch_id").agg(F.sort_array(F.collect_set("order_id")).alias("order_ids"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")
