"""Personal data: protected entities, and terms that give one away.

An entity is the value of a match: one e-mail address, one card number, one
secret that is written behind its name. A term is a word of a text that has the
entity, however far from it. Over the whole corpus, ``disclosing`` counts in
how many documents a term stands, and in how many of them the entity does. The
share, held back a little where there are few, is the chance p(entity | term);
with the entity's own rate it gives the bits that the term reveals. A term over
the thresholds identifies the entity even where the match itself is cut out, so
it is a span of kind ``term`` wherever it stands.

Copies count once: term and entity have to meet in two texts, and in APART of
these each of them has to follow and to be followed by something else, or each
word of a text that was copied with a change here and there would seem to
disclose. An entity that many of its texts' words would give away stands in
texts that are copies of each other, however changed, so none of them does.

``sanitise`` generalises matches to their kind and removes terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import filter_bits, keep, passes, release, small_batches, split_by_key, table, text_of

KINDS = ("email", "ip", "card", "phone", "secret", "term")
#: Kinds that every caller gets; the others are the method's.
BASE = 4
_LOCAL = "A-Za-z0-9._%+-"
#: Each kind's pattern, and the characters that a match's first part takes in whole: a search that starts only where such a run starts is linear.
_EMAIL = rf"[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
EMAIL_HERE, EMAIL_NEXT = re.compile(_EMAIL), re.compile(rf"(?<![{_LOCAL}]){_EMAIL}")
IP_HERE, IP_NEXT = re.compile(_IP), re.compile(rf"(?<![0-9]){_IP}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\W_][\w'-]*")
#: A value behind its name, a key by its form, and a key block; the value is the span.
SECRET = re.compile(
    r"""(?:token|secret|passw(?:or)?d|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|client[ _-]?secret|credentials?|authorization)["']?\s{0,3}[:=]\s{0,3}(?:bearer\s{1,3})?["']?(?P<value>(?=[^\s"'<>]{0,512}[0-9])[^\s"'<>]{6,512})"""
    r"""|(?P<form>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,80}|sk-[0-9A-Za-z_-]{20,200})\b)"""
    r"""|(?P<block>-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)""",
    re.I,
)
SECRET_HINT = re.compile(r"[:=]|AKIA|gh[pousr]_|xox|sk-|-----BEGIN")

#: Characters before and after a word or match that tell whether it stands in another place.
AROUND = 60
#: The least chance of the entity where the term is, the least bits that the term reveals (for a frequent entity, the least share of the bits that knowing it gives), and the least bits by which all meetings together are no chance.
CHANCE, BITS, SHARE, EVIDENCE = 0.6, 5.0, 0.75, 8.0
#: The least share of texts whose surroundings differ, and the most terms that give one entity away: a few, or a share of the words of a text.
APART, FEW, MOST = 0.75, 3, 0.05
#: Documents of which a term has half the weight of none, so that a term of one document is never sure.
HELD_BACK = 0.5
#: Entities of more documents than this would be left out: none is, as SHARE decides for those of which no term can reveal BITS.
FREQUENT = float("inf")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _runs(text: str, here: re.Pattern, after: re.Pattern) -> Iterator[re.Match]:
    at = 0
    while m := here.match(text, at) or after.search(text, at):
        yield m
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, in order; kind indexes KINDS."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _runs(text, EMAIL_HERE, EMAIL_NEXT)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _runs(text, IP_HERE, IP_NEXT) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def all_spans(text: str) -> list[tuple[int, int, int]]:
    """The fixed patterns' matches and the secrets."""
    out = base_spans(text)
    if SECRET_HINT.search(text):
        out += [(m.start(g), KINDS.index("secret"), m.end(g)) for m in SECRET.finditer(text) for g in (m.lastgroup,)]
    return sorted(out)


def _entity(text: str, span: tuple[int, int, int]) -> str:
    start, kind, end = span
    value = text[start:end]
    return f"{KINDS[kind]}:{''.join(DIGIT.findall(value)) if KINDS[kind] in ('card', 'phone') else value.lower() if kind == 0 else value}"


def _sides(text: str, start: int, end: int, own: int) -> tuple[int, int]:
    """Hashes of what stands before and after; the edge of a text is like no other text's."""
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    return tuple(xxhash.xxh64_intdigest(x, seed=0 if x else own) - (1 << 63) for x in (before, after))


def _entities(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """Each entity of a text, with what stands around its first match."""
    out, own = {}, xxhash.xxh64_intdigest(text) | 1
    for span in spans:
        entity = _entity(text, span)
        if entity not in out:
            out[entity] = (entity, *_sides(text, span[0], span[2], own))
    return sorted(out.values())


def _terms(text: str) -> list[tuple[str, int, int]]:
    """Each word of a text that is no part of a match, with what stands around the first such place."""
    out, own, spans, at = {}, xxhash.xxh64_intdigest(text) | 1, all_spans(text), 0
    reach = np.maximum.accumulate([e for _, _, e in spans]) if spans else []
    for m in WORD.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            at += 1
        if (at == 0 or reach[at - 1] <= m.start()) and (word := m[0].lower()) not in out:
            out[word] = (word, *_sides(text, m.start(), m.end(), own))
    return list(out.values())


SPAN = "struct<start:int,kind:int,end:int>"
SCANNED = f"spans array<{SPAN}>, entities array<struct<entity:string,left:long,right:long>>"


def text_key() -> Column:
    """A text's results depend on it alone, so this joins them to its rows."""
    return F.xxhash64(text_of())


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        spans = [all_spans(t) for t in texts]
        yield pd.DataFrame({"spans": spans, "entities": [_entities(t, s) if s else [] for t, s in zip(texts, spans, strict=True)]})
    release()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, the spans of each row's matches, and its entities."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", text_key().alias("text_key"), F.pandas_udf(_scan, SCANNED)(text_of()).alias("r")).select("doc_id", "text_key", "r.*")


def _hashes(terms: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in terms], np.uint64)


def _words_of(docs: DataFrame, terms: DataFrame, take, schema: str) -> DataFrame:
    """What take gathers in each task from the words that may be among the terms."""
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits("hash", terms))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask, seen = np.frombuffer(bits.value, np.uint8), {}
        taker = take()
        for rows in batches:
            for key, text in zip(rows["text_key"], rows["text"], strict=True):
                words = [(m, m[0].lower()) for m in WORD.finditer(text)]
                if new := list({w for _, w in words if w not in seen}):
                    if len(seen) > 200_000:
                        seen.clear()
                        new = list({w for _, w in words})
                    seen.update(zip(new, passes(mask, _hashes(new)).tolist(), strict=True))
                taker.add(key, [(m, w) for m, w in words if seen[w]])
            if len(taker.rows) > taker.HELD:
                yield taker.flush()
        yield taker.flush()
        seen.clear()
        release()

    return docs.select(text_key().alias("text_key"), text_of().alias("text")).mapInPandas(run, schema)


class _Count:
    """In how many documents each term comes; the counts of so many terms are held before they are given on."""

    HELD = 200_000

    def __init__(self):
        self.rows: Counter = Counter()

    def add(self, key, words) -> None:
        self.rows.update({w for _, w in words})

    def flush(self) -> pd.DataFrame:
        out = pd.DataFrame({"term": pd.Series(list(self.rows), dtype=object), "n": pd.Series(list(self.rows.values()), dtype="int64")})
        self.rows = Counter()
        return out


class _Place:
    """Where each term stands."""

    HELD = 10_000

    def __init__(self):
        self.rows: list = []

    def add(self, key, words) -> None:
        self.rows += [(key, w, m.start(), m.end()) for m, w in words]

    def flush(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=["text_key", "term", "start", "end"]).astype({"text_key": "int64", "term": object, "start": "int32", "end": "int32"})
        self.rows = []
        return out


def _hashed(terms: DataFrame) -> DataFrame:
    """terms with the hash that the filter takes, made by the same function as in _words_of."""
    return terms.mapInPandas(lambda batches: (pd.DataFrame({"term": pd.Series(list(rows["term"]), dtype=object), "hash": _hashes(list(rows["term"])).astype(np.int64)}) for rows in batches), "term string, hash long")


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """entity, term, what stands around the term, copies and first (1 once for each text), of each text's entities and terms."""
    held = []

    def flush() -> pd.DataFrame:
        return pd.DataFrame(held, columns=["entity", "term", "left", "right", "copies", "first"]).astype({"entity": object, "term": object, "left": "int64", "right": "int64", "copies": "int64", "first": "int32"})

    for rows in batches:
        for text, entities, copies in zip(rows["text"], rows["entities"], rows["copies"], strict=True):
            terms = _terms(text)
            for entity in entities:
                held += [(entity, *term, copies, not i) for i, term in enumerate(terms)]
                if len(held) > 50_000:
                    yield flush()
                    held = []
    yield flush()
    release()


def _apart() -> Column:
    """Whether grouped rows, one of each text, stand in places of which most differ on both sides."""
    texts = F.count(F.lit(1))
    return (texts >= 2) & (F.count_distinct("left") >= APART * texts) & (F.count_distinct("right") >= APART * texts)


def disclosing(docs: DataFrame, scanned: DataFrame, chance: float = CHANCE, bits: float = BITS, evidence: float = EVIDENCE) -> DataFrame:
    """text_key and the spans of disclosing terms, for texts that have some."""
    n_docs = scanned.count()
    texts = keep(scanned.where(F.size("entities") > 0).groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.any_value("entities").alias("entities")))
    each = texts.select("text_key", "copies", F.inline("entities"))
    entities = each.groupBy("entity").agg(_apart().alias("apart"), F.sum("copies").alias("n_entity")).where("apart")
    entities = keep(entities.select("entity", "n_entity"))
    if entities.isEmpty():
        return docs.sparkSession.createDataFrame([], f"text_key long, terms array<{SPAN}>")
    wanted = keep(each.join(entities, "entity").groupBy(F.col("text_key").alias("key")).agg(F.any_value("copies").alias("copies"), F.collect_set("entity").alias("entities")))
    _, perhaps = split_by_key(docs.select(text_key().alias("key"), text_of().alias("text")), wanted)
    met = perhaps.dropDuplicates(["key"]).join(wanted, "key").select("text", "entities", "copies").mapInPandas(_meetings, "entity string, term string, left long, right long, copies long, first int")
    met = keep(met)
    shared = keep(met.groupBy("entity", "term").agg(_apart().alias("apart"), F.sum("copies").alias("n_both")).where("apart"))
    candidates = keep(_hashed(shared.select("term").distinct()))
    counted = _words_of(docs, candidates, _Count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    p = F.col("n_both") / (F.greatest("n_term", "n_both") + HELD_BACK)
    all_bits = F.log2(n_docs / F.col("n_entity"))
    found = keep(
        shared.join(counted, "term").join(entities, "entity")
        .where((p >= chance) & (all_bits > 0) & (F.log2(p) + all_bits >= F.least(F.lit(bits), SHARE * all_bits)) & (F.col("n_both") * all_bits >= evidence))
        .select("entity", "term")
    )
    sizes = met.groupBy("entity").agg((F.count(F.lit(1)) / F.sum("first")).alias("words"))
    few = found.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).join(sizes, "entity").where(F.col("n") <= F.greatest(F.lit(FEW), MOST * F.col("words")))
    terms = keep(_hashed(found.join(few.select("entity"), "entity").select("term").distinct()))
    span = F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end")
    found = _words_of(docs, terms, _Place, "text_key long, term string, start int, end int")
    return keep(found.join(terms, "term", "left_semi").groupBy("text_key").agg(F.collect_set(span).alias("terms")))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and spans (of matches and terms, in order) for each row of docs.

    Null texts equal the empty text and have no spans. Rows with equal texts
    get equal spans; null ids come out as they went in. An empty table gives
    no rows. Only doc_id and text are read.
    """
    scanned = keep(scan(docs))
    both = scanned.select("doc_id", "text_key", "spans").join(disclosing(docs, scanned), "text_key", "left")
    return both.select("doc_id", "text_key", F.sort_array(F.concat("spans", F.coalesce("terms", F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def replace_spans(text: str, spans) -> str:
    """Matches become <KIND>, terms go; of overlapping spans the first counts."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], "" if KINDS[kind] == "term" else f"<{KINDS[kind].upper()}>"]
            at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with spans generalised or removed in text, and n_chars to match where docs have it. Null texts stay null."""

    def rewrite(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([t if t is None or s is None or not len(s) else replace_spans(t, sorted((x["start"], x["kind"], x["end"]) for x in s)) for t, s in zip(texts, spans, strict=True)], dtype=object)

    found = keep(find_spans(docs).where(F.size("spans") > 0).select(F.col("text_key").alias("key"), "spans").dropDuplicates(["key"]))
    rows = docs.select(F.struct("*").alias("row"), text_key().alias("key"))
    same, perhaps = split_by_key(rows, found)
    clean = perhaps.join(found, "key", "left").select("row", F.pandas_udf(rewrite, "string")("row.text", "spans").alias("clean"))
    columns = [F.col("clean").alias("text") if c == "text" else F.length("clean").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return same.select("row.*").unionByName(clean.select(*columns))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(BASE)), F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), *map(count, range(BASE, len(KINDS))))
