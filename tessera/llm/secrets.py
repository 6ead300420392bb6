"""Secret scan through a trigram inverted index.

1. Each rule's regular expression gives a Boolean query of mandatory trigrams.
2. Postings: which documents hold which of the queries' trigrams, in shards of
   about ``SHARD_DOCS`` documents, so that no posting list grows with the corpus.
3. Each query is evaluated on the postings of each shard by intersecting and
   uniting lists; the candidates get one bit for each rule.
4. Only candidates are matched against a rule; a rule without mandatory trigrams
   is matched against every text.

All of it is DataFrame functions.  Results for odd input: null or empty text has no
span; a very long text is matched whole; ids may be of any type (postings hold
their hash, so a clash of hashes makes a candidate more); a null id is a key of
its own; rows that share an id share candidates and are matched each; spans that
begin together stand in the order of the rules; columns that aren't carried are
ignored, and a carried one that is called like one of the result is given with
``_in`` added; an empty table gives an empty table.  Spans are in code points, end
exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.trigrams import Query, trigram_query, trigrams_of
from tessera.llm.workspace import Workspace, carried, column, given_back

SHARD_DOCS, SENT_ROWS = 4096, 500_000


@dataclass(frozen=True)
class Secret:
    """A kind of secret: leftmost non-overlapping matches whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds first, in the order of the contract.
BASE = (
    Secret("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Secret("access", r"AKIA[A-Z0-9]+", 0, 16),
    Secret("hex", r"[0-9a-f]{32,}"),
)
ADDED = (
    Secret("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Secret("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Secret("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Secret("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + ADDED


def _evaluate(query: Query, postings: Column) -> Column:
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(postings, F.lit(query)), F.array().cast("array<long>"))
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, (_evaluate(q, postings) for q in query[1]))


def candidates(docs: DataFrame, rules: Sequence[Secret]) -> DataFrame:
    """(key, rule_bits) of documents that satisfy the trigram query of a rule; rules without one have no bit."""
    queries = {i: q for i, q in enumerate(map(trigram_query, (r.pattern for r in rules))) if q is not True}
    grams = sorted(set().union(*map(trigrams_of, queries.values()))) if queries else []
    low = docs.select("key", F.lower("text").alias("low"))
    held = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains("low", g))
    shards = -(-docs.count() // SHARD_DOCS) or 1
    postings = low.select("key", F.explode(held).alias("gram")).groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "gram").agg(F.collect_set("key").alias("keys"))
    index = postings.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("postings"))

    def marked(i: int, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(1 << i).cast("long").alias("bit")))

    found = [marked(i, _evaluate(q, F.col("postings"))) for i, q in queries.items()]
    return index.select(F.explode(F.concat(*found)).alias("c")).groupBy("c.key").agg(F.bit_or("c.bit").alias("rule_bits"))


def _spans(rule: Secret, rank: int, text: Column) -> Column:
    """Spans of a rule: texts between matches and matches, laid end to end."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    rows = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), checked.alias("checked"))
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))).cast(kind)
        keep = x["hit"].isNotNull() & (F.length(x["checked"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))
    return F.aggregate(rows, start, step, lambda acc: acc["spans"])


def find_secrets(docs: DataFrame, *, rules: Sequence[Secret] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """id, ``secrets`` (structs start, rank, end, kind by start and rank) of every row, and ``carry``."""
    base = docs.select(column(id_col).alias("id"), F.xxhash64(column(id_col)).alias("key"), F.coalesce(column(text_col), F.lit("")).alias("text"), *carried(carry))
    work = Workspace(docs.sparkSession, "secrets")
    chosen = work.save(candidates(base, rules), "candidates")
    if chosen.count() <= SENT_ROWS:
        chosen = F.broadcast(chosen)
    asked = base.join(chosen, "key", "left").withColumn("rule_bits", F.coalesce("rule_bits", F.lit(0).cast("long")))
    text = F.col("text")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    found = {}
    for i, r in enumerate(rules):
        indexed = trigram_query(r.pattern) is not True
        asks = F.col("rule_bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0 if indexed else F.lit(True)
        found[f"spans_{i}"] = F.when(asks & text.rlike(r.pattern), _spans(r, i, text)).otherwise(none)
    every = F.sort_array(F.concat(*(F.col(n) for n in found)))
    return asked.withColumns(found).select(F.col("id").alias(id_col), every.alias("secrets"), *given_back(carry, (id_col, "secrets")))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
