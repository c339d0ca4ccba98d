"""N-gram Jaccard join with prefix filters under several global token orders.

A token is a shingle of five words. Two sets of n tokens with a Jaccard
similarity of 0.75 or more share a token among the first n // 4 + 1 of each,
in any order of all tokens. ``Orders`` gives several such orders: rare tokens
come first in all of them, by exact numbers of documents for those that are
common, and the rest is shuffled differently in each. A pair of documents is a
candidate only if it shares prefix tokens in every order. Most prefix tokens
stand in one document alone, so what is left of the prefixes is short, and the
filters of all orders are intersected before any set moves. Each set has a
parity: PARITY bits, of which each token turns one over. Sets that differ in d
tokens have parities that differ in d bits at most, so that most pairs below
the similarity are told by their parities, while they are joined.

Documents with equal sets are one class. Links are found in two steps, so
that a large group of near copies never becomes all its pairs:

1. Classes with the same least hash are a slot. Those whose parities allow a
   link with the leader of a slot are held against it: first with the class whose least hashes are the most common ones, then, where a slot
   still has several components, with others. The links give components.
   Groups of a prefix token that are still large are treated alike.
2. All candidates whose classes are in different components yet are
   verified. As these are all pairs that may still link, no link between
   components is lost.

Only the sizes, a bounded table of common tokens and filters of bounded size
reach the driver. Sets are told apart by 64-bit hashes of words and shingles.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import WordHashes, filter_bits, forget, grams, keep, mix64, one_of_each, passes, release, small_batches, table, text_of

WORDS = 5
ORDERS = 3
#: Least hashes of a set, in how many slots a class has to meet a leader for step 1 to hold them against each other, and how often slots get a leader.
MINIMA, AGREE, LEADERS = 6, 1, 2
#: Bits of a set's parity.
PARITY = 512
#: Entries of the table of common tokens that is broadcast: the most common ones, down to a number of documents that lets so many in.
COMMON_TOKENS = 1 << 20
#: Tokens that are counted together in one group, and tokens that a task gathers before it deals them out.
PART_TOKENS, HELD_TOKENS = 400_000, 1_000_000
#: Sets that are held against one set in one group.
BLOCK = 128
#: Classes of a prefix token beyond which one of them is held against the rest first, and how often.
LARGE, ROUNDS = 2000, 3


def shingle_set(text: str, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    h = hashes.of(text.encode("utf-8", "surrogatepass").lower().split())  # of bytes, these know A-Z and the six blanks only
    return np.unique(grams(h, min(WORDS, len(h)))) if len(h) else h


def shingle_sets(texts: Iterable[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The shingle_set of each text, one after the other, and how many each has."""
    words = [hashes.of(t.encode("utf-8", "surrogatepass").lower().split()) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    n = np.where(lengths < WORDS, lengths > 0, lengths - WORDS + 1)
    ends = np.cumsum(n)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint64)
    if len(flat := np.concatenate([w for w in words if len(w) >= WORDS] or [out[:0]])):
        last = np.cumsum(lengths[lengths >= WORDS])  # shingles that begin in the last words of a text would reach into the next one
        inside = np.ones(len(flat), bool)
        for k in range(1, WORDS):
            inside[last - k] = False
        out[np.repeat(lengths >= WORDS, n)] = grams(flat, WORDS)[inside[: len(flat) - WORDS + 1]]
    for k in np.flatnonzero((lengths < WORDS) & (lengths > 0)):
        out[ends[k] - 1] = grams(words[k], len(words[k]))[0]
    first = np.ones(len(out), bool)
    for i, j in zip((ends - n).tolist(), ends.tolist(), strict=True):
        out[i:j].sort()
    first[1:] = out[1:] != out[:-1]
    first[(ends - n)[n > 0]] = True
    before = np.append(0, np.cumsum(first))
    return out[first], before[ends] - before[ends - n]


def parities(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of PARITY // 64 longs for each of the sets that tokens has one after the other, n tokens each."""
    at = np.repeat(np.arange(len(n)) * PARITY, n) + (mix64(tokens, 300) % np.uint64(PARITY)).astype(np.int64)
    odd = np.bincount(at, minlength=len(n) * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(n), -1)


def _features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for texts in batches:
        tokens, n = shingle_sets(texts, hashes)
        ends, some = np.cumsum(n), np.flatnonzero(n)
        blobs = [tokens[i:j].tobytes() for i, j in zip((ends - n).tolist(), ends.tolist(), strict=True)]
        minima = np.zeros((len(n), MINIMA), np.int64)
        for k in range(MINIMA if len(some) else 0):
            order = tokens * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) & 0xFFFFFFFFFFFFFFFF)  # tokens are hashes, so a multiple of each is order enough
            minima[some, k] = (np.minimum.reduceat(order, (ends - n)[some]) >> np.uint64(1)).astype(np.int64)
        minima = [list(x) if k else [] for x, k in zip(minima, n, strict=True)]
        yield pd.DataFrame({"key": pd.Series([xxhash.xxh3_64_intdigest(b) - (1 << 63) for b in blobs], dtype="int64"), "n": n.astype(np.int32), "minima": minima, "parity": list(parities(tokens, n)), "tokens": blobs})
    del hashes
    release()


def _set(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


def _once(batches: Iterator[pd.DataFrame], mask) -> Iterator[tuple[int, np.ndarray]]:
    """(key, set) of rows (h, key, tokens) whose hash h may be in the filter mask; copies in the same task come once."""
    bits, seen = np.frombuffer(mask.value, np.uint8), set()
    for rows in batches:
        rows = rows[passes(bits, rows["h"].to_numpy())]
        for key, blob in zip(rows["key"], rows["tokens"], strict=True):
            if key not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                yield key, _set(blob)


class Orders:
    """Several orders of all tokens.

    A token is counted by its number, 40 bits beside the part (of 2 ** bits)
    that it is counted in. common: sorted numbers of the common tokens; level:
    how common each is.
    """

    def __init__(self, bits: int, common: np.ndarray, level: np.ndarray):
        self.bits, self.common, self.level = bits, common, level
        self.perhaps = np.zeros(1 << 22, bool)  # saves most searches
        self.perhaps[(common & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def levels(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.uint64)
        if len(self.common):
            maybe = np.flatnonzero(self.perhaps[(numbers & np.uint64((1 << 22) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.common, numbers[maybe]), len(self.common) - 1)
            hit = self.common[at] == numbers[maybe]
            out[maybe[hit]] = self.level[at[hit]]
        return out

    def prefixes(self, tokens: np.ndarray, orders: range) -> Iterator[np.ndarray]:
        """For each order, the first n // 4 + 1 tokens of a set, in that order."""
        high, most = self.levels(numbers(tokens, self.bits)) << np.uint64(58), len(tokens) // 4 + 1
        for k in orders:
            rank = (mix64(tokens, k) >> np.uint64(6)) | high
            if most < len(tokens):
                best = np.argpartition(rank, most - 1)[:most]
                yield tokens[best[np.argsort(rank[best])]]
            else:
                yield tokens[np.argsort(rank)]


def numbers(tokens: np.ndarray, bits: int) -> np.ndarray:
    return mix64(tokens, 60) >> np.uint64(24 - bits)


def _dealt(bits: int, mask):
    """For a mapInPandas over rows that ``_once`` takes: the tokens of a task with how often they come, dealt into parts."""

    def flush(held: list[np.ndarray]) -> pd.DataFrame:
        number, n = np.unique(numbers(np.concatenate(held), bits), return_counts=True)
        times = -(-n // 255)  # a larger number is sent in several bytes, which are added up again
        last, number = np.cumsum(times) - 1, np.repeat(number, times)
        rest, n = n - 255 * (times - 1), np.full(len(number), 255, np.uint8)
        n[last] = rest
        part = (number >> np.uint64(40)).astype(np.int64)
        code = np.ascontiguousarray(number.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        slices = list(zip(begin, np.append(begin[1:], len(part)), strict=True))
        return pd.DataFrame({"part": part[begin], "codes": [code[i:j].tobytes() for i, j in slices], "n": [n[i:j].tobytes() for i, j in slices]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for _, tokens in _once(batches, mask):
            held.append(tokens)
            size += len(tokens)
            if size > HELD_TOKENS:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)
        del held
        release()

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """The tokens of a part that come twice or more, with their numbers of documents."""
    n = np.frombuffer(b"".join(rows["n"]), np.uint8).astype(np.int64)
    code = np.zeros((len(n), 8), np.uint8)
    code[:, :5] = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(-1, 5)
    both = np.sort(code.view("<u8").ravel() << np.uint64(8) | n.astype(np.uint64))  # faster than sorting positions
    code, n = both >> np.uint64(8), (both & np.uint64(255)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    total = np.add.reduceat(n, begin)
    several = total > 1
    number = code[begin][several] | np.uint64(int(rows["part"].iloc[0]) << 40)
    return pd.DataFrame({"number": number.astype(np.int64), "n": total[several]})


def shared_tokens(sets: DataFrame, total: int, mask) -> tuple[DataFrame, int]:
    """number and n of each token that comes in two sets or more, counted over all sets (h, key, tokens) that mask lets through; and the bits of parts."""
    bits = min(23, max(0, math.ceil(math.log2(max(1, total / PART_TOKENS)))))
    dealt = sets.mapInPandas(_dealt(bits, mask), "part long, codes binary, n binary")
    return keep(dealt.groupBy("part").applyInPandas(_added, "number long, n long")), bits


def global_orders(shared: DataFrame, bits: int) -> Orders:
    """The orders that put the most common tokens last, by powers of two of their numbers of documents."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r["level"]: r["count"] for r in shared.groupBy(level.alias("level")).count().collect()}
    least, n = 63, 0
    while least > 1 and n + sizes.get(least - 1, 0) <= COMMON_TOKENS:
        least -= 1
        n += sizes.get(least, 0)
    common = shared.where(level >= least).select("number", level.alias("level")).toArrow()
    number, levels = common["number"].to_numpy().astype(np.uint64), common["level"].to_numpy().astype(np.uint8)
    order = np.argsort(number)
    return Orders(bits, number[order], levels[order])


def _prefix_rows(orders, shared, which: range, mask):
    """For a mapInPandas over rows that ``_once`` takes: order, token, key, n and at (the place in the prefix) of prefix tokens that may be in two sets or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        o, bits, held = orders.value, np.frombuffer(shared.value, np.uint8), []

        def flush() -> pd.DataFrame:
            order, token, key, n, at = (np.concatenate(x) for x in zip(*held, strict=True))
            return pd.DataFrame({"order": order, "token": token.view(np.int64), "key": key, "n": n, "at": at})

        for key, tokens in _once(batches, mask):
            for k, prefix in zip(which, o.prefixes(tokens, which), strict=True):
                at = np.flatnonzero(passes(bits, numbers(prefix, o.bits)))
                held.append((np.full(len(at), k, np.int32), prefix[at], np.full(len(at), key, np.int64), np.full(len(at), len(tokens), np.int32), at.astype(np.int32)))
            if len(held) > 1000:
                yield flush()
                held = []
        if held:
            yield flush()
        del held
        release()

    return run


PREFIX = "order int, token long, key long, n int, at int"


def between_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """The prefix rows whose token stands in classes of different components, with comp."""
    rows = keep(rows.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key")))
    mixed = keep(rows.groupBy("order", "token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("order", "token"))
    out = keep(rows.join(mixed, ["order", "token"], "left_semi"))
    forget(rows, mixed)
    return out


def _verify_block(rows: pa.Table) -> pa.Table:
    """rows of one block: the set that all others are held against has role 0."""
    sets, role = dict(zip(rows["key"].to_pylist(), rows["tokens"].to_pylist(), strict=True)), rows["role"].to_pylist()
    a, out = rows["key"][role.index(0)].as_py(), []
    one = _set(sets.pop(a))
    for key, blob in sets.items():
        other = _set(blob)
        if 4 * min(len(one), len(other)) >= 3 * max(len(one), len(other)):
            both = np.concatenate([one, other])
            both.sort(kind="stable")  # two sorted runs are merged
            if 7 * np.count_nonzero(both[1:] == both[:-1]) >= 3 * len(both):
                out.append(key)
    return pa.table({"a": pa.array([a] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})


def similar_sizes(a: str, b: str) -> Column:
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def may_link(a: str, b: str) -> Column:
    """Whether sizes and parities allow a link; columns n and parity with the endings a and b."""
    apart = functools.reduce(Column.__add__, [F.bit_count(F.col(f"parity{a}")[k].bitwiseXOR(F.col(f"parity{b}")[k])) for k in range(PARITY // 64)])
    return similar_sizes(f"n{a}", f"n{b}") & (7 * apart <= F.col(f"n{a}") + F.col(f"n{b}"))


def verified(pairs: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b of classes) whose sets are similar enough. Each block holds one set against about BLOCK others at most; sets whose sizes rule a link out aren't moved."""
    sized = lambda c: classes.select(F.col("key").alias(c), F.col("uid").alias(f"uid_{c}"), F.col("n").alias(f"n_{c}"))
    pairs = keep(pairs.join(sized("a"), "a").join(sized("b"), "b").where(similar_sizes("n_a", "n_b")).select("a", "b", "uid_a", "uid_b"))
    per = keep(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n_pairs")))
    blocks = pairs.join(per, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.ceil(F.col("n_pairs") / BLOCK)))
    needs = blocks.select("a", "block", F.col("uid_b").alias("uid"), F.lit(1).alias("role")).unionByName(blocks.select("a", "block", F.col("uid_a").alias("uid"), F.lit(0).alias("role")).distinct())
    needs = keep(needs)
    hashed = F.xxhash64("uid")
    bits = sets.sparkSession.sparkContext.broadcast(filter_bits(hashed, needs))

    @F.pandas_udf("boolean")
    def needed(hashes: pd.Series) -> pd.Series:
        return pd.Series(passes(np.frombuffer(bits.value, np.uint8), hashes.to_numpy()))

    some = sets.select("uid", "key", "tokens").where(needed(hashed))
    out = keep(needs.join(some, "uid").drop("uid").groupBy("a", "block").applyInArrow(_verify_block, "a long, b long"))
    forget(pairs, per, needs)
    return out


def against_leader(members: DataFrame, by: list[str], order: Column, *carried: str) -> DataFrame:
    """The leader of each group (the last in order) with each member of another component: a, b, and the columns of carried for both. members: by, key, comp, carried."""
    taken = ["key", "comp", *carried]
    leader = keep(members.groupBy(*by).agg(F.max(F.struct(order.alias("o"), *taken)).alias("l")).select(*by, *[F.col(f"l.{c}").alias(f"{c}_a") for c in taken]))
    pairs = members.join(leader, by).where("comp <> comp_a")
    return pairs.select(F.col("key_a").alias("a"), F.col("key").alias("b"), *[x for c in carried for x in (F.col(f"{c}_a"), F.col(c).alias(f"{c}_b"))])


def several_components(members: DataFrame, by: list[str]) -> DataFrame:
    mixed = keep(members.groupBy(*by).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(*by))
    return members.join(mixed, by, "left_semi")


def leaders_of(slots: DataFrame, comps: DataFrame | None, turn: int) -> DataFrame:
    """Pairs of a leader and a class that may link with it and is in AGREE of its slots. slots: k, least, key, n, parity, weight (how common the class's least hashes are)."""
    members = slots.withColumn("comp", F.col("key")) if comps is None else slots.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    order = F.struct(F.col("weight") if turn == 0 else F.lit(0.0), F.xxhash64("key", F.lit(turn)))
    pairs = against_leader(several_components(members, ["k", "least"]), ["k", "least"], order, "n", "parity")
    return pairs.where(may_link("_a", "_b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= AGREE).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """key and comp (the smallest key of its component) for each key in links (a, b), by alternating stars."""
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # kept, so that Spark can split what joins a hub
        large = keep(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        forget(before)
    return edges.groupBy(F.col("u").alias("key")).agg(F.min("v").alias("comp")).unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("comp")).distinct()).groupBy("key").agg(F.min("comp").alias("comp"))


def candidates(rows: DataFrame) -> DataFrame:
    """a and b, the one with fewer tokens first: classes of different components that share a prefix token, where sizes, places in the prefix and parities allow a link."""
    size = F.floor(F.log("n") / math.log(4 / 3)).cast("int")  # similar sets are in the same class of sizes or in the next
    columns = ["key", "n", "at", "comp", "parity"]
    smaller = rows.select("token", F.explode(F.array(size, size + 1)).alias("size"), *[F.col(c).alias(f"{c}_x") for c in columns])
    larger = rows.select("token", size.alias("size"), *[F.col(c).alias(f"{c}_y") for c in columns])
    once = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("key_x") < F.col("key_y")))
    overlap = 7 * F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) >= 3 * (F.col("n_x") + F.col("n_y"))  # holds at a similar pair's first shared token
    pairs = smaller.join(larger, ["token", "size"]).where(once & (F.col("comp_x") != F.col("comp_y")) & overlap & may_link("_x", "_y"))
    return pairs.select(F.col("key_x").alias("a"), F.col("key_y").alias("b")).distinct()


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, component_id and comp (null without words) for each row of docs.

    Null texts equal the empty text; rows without words have no shingles and
    are linked with nothing, so component_id is their own doc_id. Rows with
    equal sets are linked, repeated rows too. A null doc_id is never a
    component_id while another row of the component has an id. An empty table
    gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    links: list[DataFrame] = []

    def components_so_far() -> DataFrame:
        return keep(components(functools.reduce(DataFrame.unionByName, links)))

    features = F.pandas_udf(_features, "key long, n int, minima array<long>, parity array<long>, tokens binary")(text_of())
    sets = keep(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64(text_of()).alias("text_key"), features.alias("f")).select("uid", "doc_id", "text_key", "f.*"))
    worded = sets.where("n > 0")
    classes = keep(worded.groupBy("key").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.any_value("minima").alias("minima"), F.any_value("parity").alias("parity")))
    total = worded.agg(F.sum("n")).first()[0] or 0
    without = sets.where("n = 0").select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("comp"))
    if not total:
        return without

    # Equal sets are counted once: of each class one row is left, and perhaps a few more, which do no harm.
    by_row = lambda frame: frame.select(F.xxhash64("uid").alias("h"), "key", "tokens")
    representative = spark.sparkContext.broadcast(filter_bits(F.xxhash64("uid"), classes))

    # Step 1: classes against the leaders of their slots.
    exploded = classes.select("key", "n", "parity", F.posexplode("minima").alias("k", "least"))
    sizes = keep(exploded.groupBy("k", "least").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1))
    shared_slots = keep(exploded.join(sizes, ["k", "least"]))
    weights = keep(shared_slots.groupBy("key").agg(F.sum(F.log2("size")).alias("weight")))
    slots = keep(shared_slots.join(weights, "key"))
    comps = None
    for turn in range(LEADERS):
        found = verified(leaders_of(slots, comps, turn), sets, classes)
        links.append(found)
        if comps is not None and found.isEmpty():
            break
        comps = components_so_far()
    forget(sizes, shared_slots, weights, slots)  # the links that they gave are written

    # Prefix tokens of the first order that stand in different components; then those of the other orders, for classes that have such.
    shared, bits = shared_tokens(by_row(worded), total, representative)
    orders = spark.sparkContext.broadcast(global_orders(shared, bits))
    several = spark.sparkContext.broadcast(filter_bits("number", shared))
    first = between_components(by_row(worded).mapInPandas(_prefix_rows(orders, several, range(1), representative), PREFIX).repartition("key").distinct(), comps)
    for salt in range(1, ROUNDS + 1):
        large = keep(first.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LARGE).select("token"))
        if large.isEmpty():
            break
        links.append(verified(against_leader(first.join(large, "token", "left_semi"), ["token"], F.xxhash64("key", F.lit(salt))).distinct(), sets, classes))
        comps = components_so_far()
        first = between_components(first.drop("comp"), comps)

    # Step 2: candidates of all orders between components.
    parity = classes.select("key", "parity")
    pairs = keep(candidates(first.join(parity, "key")))
    either = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    paired = spark.sparkContext.broadcast(filter_bits("key", either))
    others = worded.select(F.col("key").alias("h"), "key", "tokens").mapInPandas(_prefix_rows(orders, several, range(1, ORDERS), paired), PREFIX).repartition("key").distinct()
    others = keep(between_components(others, comps).join(parity, "key"))
    for k in range(1, ORDERS):
        pairs = keep(pairs.join(candidates(others.where(F.col("order") == k)), ["a", "b"], "left_semi"))
    links.append(verified(pairs, sets, classes))

    comps = components_so_far()
    found = keep(classes.select("key", "doc_id").join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key")))
    least = keep(found.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    labels = keep(found.join(least, "comp").select("key", "component_id", "comp"))
    out = worded.select("doc_id", "text_key", "key", F.col("n").cast("long").alias("n_shingles")).join(labels, "key").drop("key")
    out = keep(out.unionByName(without))
    forget(sets, classes, shared, pairs, found, least, labels)  # the sets are about as large as the texts
    return out


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: one that has the smallest doc_id. Rows without words stay, but equal ones once for each id."""
    found = keep(similar_documents(docs))
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = found.where("comp is not null").groupBy("comp").agg(F.min(row).alias("first"))
    decided = found.join(first, "comp", "left").select(F.xxhash64("doc_id", "text_key").alias("key"), (F.col("first").isNull() | (row == F.col("first"))).alias("stays"))
    return one_of_each(docs, F.xxhash64("doc_id", F.xxhash64(text_of())), decided)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
