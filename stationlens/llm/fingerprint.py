"""I-Match fingerprints over several randomised lexicon subsets, in DataFrame operations only.

The lexicon are the terms in a band of inverse document frequency, by exact counts over all documents. As a term of it is in at least one
document of ``RAREST``, it has at most ``RAREST`` times a text's terms, whatever the corpus; it is read as a bitmap
sized by it (``BITS_A_TERM``), through which one rare term in so many passes as well, the same ones in every text. A text keeps its distinct terms in the
lexicon, sorted. The lexicon is cut at random into ``SUBSETS`` disjoint subsets and thinned by powers of two, so that long
texts are hashed over as few terms a subset as short ones; each subset's sorted terms give one hash (16 bits, hashed on term
by term), a subset without terms none. A fingerprint holds the hashes at a text's own thinning and at the next, so that texts of unlike length can be
compared. Likeness is the share of subsets on which two texts agree, among those that are filled in either.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlens.llm.common import Scratch

SUBSETS = 32
#: Lexicon: terms in at most one document of the first and at least one of the second.
COMMONEST, RAREST = 2, 1000
BITS_A_TERM = 32

_TERMS = r"array_distinct(transform(filter(split(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), w -> w <> ''), w -> xxhash64(w)))"
_EMPTY = "0000"
_NULL_ID = -(1 << 63)


def lexicon(texts: DataFrame, scratch: Scratch, commonest: float = COMMONEST, rarest: float = RAREST) -> tuple[DataFrame, int]:
    """One row: ``bits``, an array of 64-bit words with a bit set for each term in the band; and how many bits, a power of two."""
    terms = texts.select(F.explode(F.expr(_TERMS.format(text="text"))).alias("h"))
    counts = terms.groupBy("h").agg(F.count("*").alias("df"))
    total = texts.agg(F.count("*").alias("n"))
    idf = F.log(total.scalar() / F.col("df"))
    held = scratch.keep(counts.filter(idf.between(math.log(commonest) - 1e-9, math.log(rarest) + 1e-9)).select("h"), "lexicon")
    width = 1 << max(10, (BITS_A_TERM * held.count()).bit_length())
    words = held.groupBy(F.expr(f"(h & {width - 1}) >> 6").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    dense = texts.sparkSession.range(width // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    return dense.agg(F.expr("transform(array_sort(collect_list(struct(word, coalesce(bits, 0L) as bits))), x -> x.bits)").alias("bits")), width


def _hashes(terms: str) -> str:
    """SQL: the hashes of a sorted array's subsets, 16 bits each in order, four subsets to a 64-bit lane; 0 where empty."""
    lane = SUBSETS // 4
    one = "((s.l{j} & ~shiftleft(65535L, {at})) | shiftleft((xxhash64(shiftrightunsigned(s.l{j}, {at}) & 65535L, h) & 65535L) | 1L, {at}))"
    at = "cast(shiftrightunsigned(h, 24) & 3L as int) * 16"
    fields = ", ".join(f"'l{j}', if((shiftrightunsigned(h, 26) & {lane - 1}L) = {j}L, {one.format(j=j, at=at)}, s.l{j})" for j in range(lane))
    start = ", ".join(f"'l{j}', 0L" for j in range(lane))
    text = ", ".join(f"lpad(hex(s.l{j}), 16, '0')" for j in range(lane))
    return f"aggregate({terms}, named_struct({start}), (s, h) -> named_struct({fields}), s -> lower(concat({text})))"


def with_fingerprints(df: DataFrame, texts: dict[str, str], width: int) -> DataFrame:
    """Adds the fingerprint of each text column (``texts``: its name -> that of its fingerprint); uses up the texts and ``bits``."""
    keep = f"array_sort(filter(_terms_{{c}}, h -> (shiftrightunsigned(element_at(bits, cast(shiftrightunsigned(h & {width - 1}, 6) as int) + 1), cast(h & 63 as int)) & 1L) = 1L))"
    thin = "filter(_band_{c}, h -> (shiftrightunsigned(h, 40) & (shiftleft(1L, _level_{c}{plus}) - 1L)) = 0L)"
    steps = [
        {"_band_{c}": keep},
        {"_level_{c}": f"cast(greatest(0, floor(log2(greatest(size(_band_{{c}}), 1) / {SUBSETS}))) as int)"},
        {"_own_{c}": thin.replace("{plus}", ""), "_next_{c}": thin.replace("{plus}", " + 1")},
    ]
    spent = [{"bits"} | {f"_terms_{c}" for c in texts}, set(), {f"_band_{c}" for c in texts}]
    # each step is a projection without what is used up, as the lexicon is large beside a row
    df = df.select(*(c for c in df.columns if c not in texts and c != "bits"), *(F.expr(_TERMS.format(text=c)).alias(f"_terms_{c}") for c in texts), "bits")
    for step, gone in zip(steps, spent, strict=True):
        made = [F.expr(sql.replace("{c}", c)).alias(name.replace("{c}", c)) for c in texts for name, sql in step.items()]
        df = df.select(*(c for c in df.columns if c not in gone), *made)
    made = [F.expr(f"concat(lpad(cast(_level_{c} as string), 2, '0'), {_hashes(f'_own_{c}')}, {_hashes(f'_next_{c}')})").alias(out) for c, out in texts.items()]
    return df.select(*(c for c in df.columns if not c.startswith("_")), *made)


def likeness(a: str, b: str) -> str:
    """SQL for the likeness (0 to 1) of two fingerprint columns: share of the filled subsets with equal hashes."""
    la, lb = (f"cast(substr({x}, 1, 2) as int)" for x in (a, b))
    cut = lambda x, own: f"substr({x}, 3 + 4 * k + {4 * SUBSETS} * (greatest({la}, {lb}) - {own}), 4)"
    pairs = f"transform(sequence(0, {SUBSETS - 1}), k -> struct({cut(a, la)} as p, {cut(b, lb)} as q))"
    filled = f"filter({pairs}, x -> x.p <> '{_EMPTY}' or x.q <> '{_EMPTY}')"
    score = f"aggregate({filled}, struct(0 as same, 0 as n), (s, x) -> struct(s.same + int(x.p = x.q) as same, s.n + 1 as n), s -> if(s.n = 0, 0D, s.same / s.n))"
    return f"case when {a} = {b} then 1D when abs({la} - {lb}) > 1 then 0D else {score} end"


def in_order(keyed: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """Distinct (kid, tie, n_chars) with ``at`` and ``next_at``: places in the ascending order, the last followed by the first.

    The rows are range-partitioned and sorted once; a row's place is its partition and its turn there. Only one row a
    partition reaches the driver, to lead from each partition's last row to the next one's first.
    """
    spark = keyed.sparkSession
    narrow = keyed.select("kid", "tie", F.length("text").alias("n_chars"))
    unique = narrow.groupBy("kid", "tie", "n_chars").agg(F.count("*").alias("copies"))
    placed = scratch.keep(unique.repartitionByRange("kid", "tie").sortWithinPartitions("kid", "tie").withColumn("at", F.monotonically_increasing_id()), "order")
    ends = sorted((r["first"], r["last"]) for r in placed.groupBy(F.expr("at >> 33")).agg(F.min("at").alias("first"), F.max("at").alias("last")).collect())
    leads = spark.createDataFrame([(ends[i][1], ends[(i + 1) % len(ends)][0]) for i in range(len(ends))], "at long, lead long")
    repeated = placed.filter("copies > 1").limit(1).count() > 0
    return placed.join(F.broadcast(leads), "at", "left").withColumn("next_at", F.coalesce("lead", F.col("at") + 1)).drop("lead", "copies"), repeated


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its fingerprint, that of its edited text, and how like it is to that and to the next document.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document in ascending order of id (nulls first; rows of one id in the order of a hash of their text; repeated rows
    count once in the order and give a row each). A null text is empty; texts without terms in the lexicon have the fingerprint without
    hashes, so likeness 1 to each other and 0 to the rest. An empty table gives no rows; other columns are ignored. Texts cross the network once,
    and a quarter of them as the parts that replace.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("kid"), F.xxhash64(text).alias("tie"), text.alias("text"))
    found, width = lexicon(keyed.select("text"), scratch)
    bits = scratch.keep(found, "bits")
    order, repeated = in_order(keyed, scratch)
    order = scratch.keep(order.select("kid", "tie", "n_chars", "at", "next_at"), "places")
    after = order.select(F.col("at").alias("next_at"), F.col("kid").alias("next_kid"), F.col("tie").alias("next_tie"))
    pairs = order.join(after, "next_at").filter("n_chars >= 4")

    # the part that replaces is cut where the next document is, and sent to the document whose end it takes
    pairs = pairs.select(F.col("next_kid").alias("kid"), F.col("next_tie").alias("tie"), F.col("kid").alias("to_kid"), F.col("tie").alias("to_tie"), F.expr("n_chars div 4").alias("many"))
    parts = keyed.join(pairs, ["kid", "tie"]).select(F.col("to_kid").alias("kid"), F.col("to_tie").alias("tie"), F.expr("substring(text, 1, cast(many as int))").alias("part"))
    if repeated:
        parts = parts.groupBy("kid", "tie").agg(F.min("part").alias("part"))
    whole = keyed.join(order, ["kid", "tie"]).join(parts, ["kid", "tie"], "left")
    edited = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), coalesce(part, ''))")
    whole = whole.select("at", "next_at", "kid", F.col("n_chars").cast("long").alias("n_chars"), "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    made = with_fingerprints(whole.withColumn("bits", bits.scalar()), {"text": "fingerprint", "edited": "edited_fingerprint"}, width)
    held = scratch.keep(made.select("at", "next_at", "kid", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"), "held")
    following = held.select(F.col("at").alias("next_at"), F.col("fingerprint").alias("next_fingerprint"))
    if repeated:
        following = following.distinct()
    return held.join(following, "next_at").select(
        F.nullif("kid", F.lit(_NULL_ID)).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        F.expr(likeness("fingerprint", "edited_fingerprint")).alias("near_edited"),
        F.expr(likeness("fingerprint", "next_fingerprint")).alias("near_next"),
    )
