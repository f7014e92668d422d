"""Secret scans over a trigram inverted index.

The index holds the postings of every trigram of every text (lower-cased), so
any rule can be asked of it later: texts are dealt into blocks, and a posting is
(trigram, block, bits), where each text of a block has one of 64 bits. A trigram
is named by 16 bits of its hash and a text's bit by its own; what shares a name
or a bit only adds candidates. Long texts are read in pieces that overlap by two
code points.

Each rule's regular expression gives a Boolean query over trigrams. The postings
of a clause are intersected, those of a rule's clauses united, and only the
texts that remain are read by the rule's pattern. Rules without mandatory
trigrams read every text.

Matches of a rule are leftmost and do not overlap; a match whose checked group
is shorter than the rule's minimum is dropped (and its characters stay used).

Defined results: a null text is empty; rows without matches have counts 0 and
an empty spans string; a row that is repeated gets as many result rows; null
doc_ids are kept; only doc_id and text are looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isolume.functions.kernels import bound
from isolume.llm.common import ascii_lower, fingerprint, running_sums, stored
from isolume.llm.trigrams import ANY, trigram_query

#: Blocks with candidates are broadcast up to this many (about 16 bytes and 8 for each rule); beyond it the join shuffles.
BROADCAST_BLOCKS = 250_000
#: Texts of a block (on average, so that most have a bit of their own), and code points of a piece.
BLOCK, PIECE = 32, 4096
#: Rows without a doc_id may be many of one text; their postings are dealt out to this many groups.
SALTS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The first three are the contract's, the others public key formats.
RULES = (
    Rule("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", "[0-9a-f]{24,}", base=True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, end, kind>> of a rule's matches, in code points, end exclusive; linear in text and matches."""
    kind = "array<struct<start:int,ord:int,end:int,kind:string>>"
    lengths = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), lambda x: F.length(x))

    def told(whole: Column) -> Column:
        gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole))
        ends = running_sums(F.zip_with(gaps, whole, lambda gap, n: F.length(gap) + n))
        spans = F.zip_with(ends, whole, lambda end, n: F.struct((end - n).cast("int").alias("start"), F.lit(order).alias("ord"), end.cast("int").alias("end"), F.lit(rule.kind).alias("kind")))
        if rule.group or rule.least > 1:
            checked = F.zip_with(spans, lengths(rule.group) if rule.group else whole, lambda span, n: F.struct(span.alias("span"), n.alias("n")))
            spans = F.transform(F.filter(checked, lambda x: x["n"] >= rule.least), lambda x: x["span"])
        return F.when(F.size(whole) > 0, spans).otherwise(F.array().cast(kind))

    return bound(lengths(0), told)


def _gram(trigram: Column) -> Column:
    """A trigram's name in the index."""
    return F.shiftright(F.hash(trigram), 16).cast("short")


def _placed(rows: DataFrame, blocks: int) -> DataFrame:
    """Adds block and slot, which doc_id and text decide."""
    place = F.xxhash64("doc_id", "fp")
    return rows.withColumn("block", F.pmod(place, F.lit(blocks)).cast("int")).withColumn("slot", F.shiftrightunsigned(place, 58).cast("int"))


@dataclass(frozen=True)
class Index:
    """Postings (trigram, block, bits) in the shared folder; a posting's bits may be dealt out to several rows."""

    postings: DataFrame
    blocks: int


def build_index(docs: DataFrame) -> Index:
    """Indexes all trigrams of all texts (doc_id, text).

    Texts' distinct trigrams are shuffled once, by block; a block's postings are then made where they lie.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    blocks = max(1, -(-rows.count() // BLOCK))
    rows = _placed(rows.withColumn("fp", fingerprint(F.col("text"))), blocks)
    low = ascii_lower(F.col("text"))
    overlapping = F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{1,{PIECE + 2}}})).{{1,{PIECE}}}"), F.lit(1))
    cut = F.when(F.length("text") <= PIECE, F.array(low)).otherwise(overlapping)
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0)
    rows = rows.select("block", salt.alias("salt"), "slot", F.explode(cut).alias("piece"))
    grams = F.array_distinct(F.transform(F.regexp_extract_all("piece", F.lit("(?s)(?=(...))"), F.lit(1)), _gram))
    rows = rows.select("block", "salt", "slot", grams.alias("grams")).filter(F.size("grams") > 0).repartition("block", "salt")
    postings = rows.select("block", "salt", F.expr("shiftleft(1L, slot)").alias("bit"), F.explode("grams").alias("trigram"))
    postings = postings.groupBy("block", "salt", "trigram").agg(F.bit_or("bit").alias("bits"))
    return Index(stored(postings.select("trigram", "block", "bits").sortWithinPartitions("trigram", "block"), "trigram_postings"), blocks)


def candidates(index: Index, rules: Sequence[Rule]) -> DataFrame:
    """(block, kinds): of each rule with a trigram query the bits of the texts that some clause leaves, in the rules' order."""
    spark = index.postings.sparkSession
    asked = [(r.kind, f"{r.kind}{n}", t, len(s)) for r in rules if (q := trigram_query(r.pattern)) != ANY for n, s in enumerate(q) for t in sorted(s)]
    clauses = spark.createDataFrame(asked, "kind string, clause string, t string, needed int").select("kind", "clause", "needed", _gram(F.col("t")).alias("trigram"), "t")
    names = sorted({r.trigram for r in clauses.select("trigram").distinct().collect()})  # as many as the rules ask for
    held = index.postings.filter(F.col("trigram").isin(names)).groupBy("block", "trigram").agg(F.bit_or("bits").alias("bits"))
    met = held.join(F.broadcast(clauses), "trigram").groupBy("block", "kind", "clause", "needed")
    met = met.agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("held")).filter("held = needed AND bits <> 0")
    kinds = list(dict.fromkeys(x[0] for x in asked))
    return stored(met.groupBy("block").agg(*[F.coalesce(F.bit_or(F.when(F.col("kind") == k, F.col("bits"))), F.lit(0)).alias(f"of_{k}") for k in kinds]), "secret_candidates")


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, index: Index | None = None) -> DataFrame:
    """Returns for every row of docs: doc_id, text and found, the sorted array<struct<start, ord, end, kind>> of all spans.

    index: that of the same rows, if there is one already.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    indexed = [r.kind for r in rules if trigram_query(r.pattern) != ANY]
    if indexed:
        index = index or build_index(rows)
        cand = candidates(index, rules)
        cand = F.broadcast(cand) if cand.count() <= BROADCAST_BLOCKS else cand.hint("shuffle_hash")
        rows = _placed(rows.withColumn("fp", fingerprint(F.col("text"))), index.blocks).join(cand, "block", "left")
    found = []
    for order, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, order)
        found.append(F.when(F.getbit(f"of_{rule.kind}", F.col("slot")) == 1, spans) if rule.kind in indexed else spans)
    return rows.select("doc_id", "text", F.array_sort(F.flatten(F.array_compact(F.array(*found)))).alias("found"))


def spans_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
