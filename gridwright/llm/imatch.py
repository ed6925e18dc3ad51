"""I-Match fingerprints in DataFrame and SQL functions only.

A text's terms are its distinct lower-case runs of letters and digits. The lexicon keeps the terms whose inverse document
frequency lies in a band: neither names and typing errors nor words that stand everywhere. ``REPLICATES`` randomised families
of lexicon subsets are drawn by hashing: family r is nested, its subset of level l holds a term with probability 4**-l. Of
each family a text takes the sparsest subset that still holds one of its terms and hashes its distinct terms in it. So each
part of the fingerprint depends on few terms, whatever the length of the text: two texts agree in about as many parts as
their terms overlap, and equal texts in all. The hash of a set of terms is the exclusive-or of their hashes, which is
the same for every order of the terms; the sort that the method names would cost more and tell no two sets apart that this
does not.

The lexicon has at most (mean number of distinct terms of a text) / ``LOW`` terms, however many documents there are: every one
of them stands in a share ``LOW`` of the documents. That bound, checked on the real table, lets terms meet it without a
shuffle. Texts move once, to blocks of neighbouring documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.storage import stored

#: Band of the document frequency as shares of the documents: idf from ln(50) to ln(500).
LOW, HIGH = 1 / 500, 1 / 50
REPLICATES, TOP_LEVEL = 16, 4
_LANE, _LANES = 16, 4  # a family's hash has 16 bits, four families share a number
_WHOLE = 15  # instead of a level: hash of a whole text
#: A text with more copies than this share of the documents counts as one document in the frequencies.
HEAVY = LOW / 5
#: Terms of a lexicon that is sent to every task; a larger one is met by a shuffle.
BROADCAST_TERMS = 500_000
BLOCK_ROWS, MOST_BLOCKS = 1000, 200_000
_SEPARATOR = r"[^\p{L}\p{N}]+"
_EVERY = 0  # stands in each text's list and in the lexicon: keeps texts without lexicon terms


def term_hashes(text: Column) -> Column:
    """The distinct terms of a text as 64-bit hashes; 0 is not one of them."""
    hashed = F.transform(F.split(F.lower(text), _SEPARATOR), lambda t: F.xxhash64(t))
    return F.array_remove(F.array_remove(F.array_distinct(hashed), F.xxhash64(F.lit(""))), F.lit(_EVERY))


def _lane(number: Column, j: int) -> Column:
    return F.shiftrightunsigned(number, _LANE * j).bitwiseAND(F.lit((1 << _LANE) - 1))


def _subsets(term: Column) -> list[Column]:
    """x<level>_<k>: of the families 4k to 4k + 3 a hash of the term each, 0 where their subset of that level lacks it. It is in the
    subset of level l if 2 l bits drawn for it are all 0."""
    out = []
    for k in range(REPLICATES // _LANES):
        value, drawn = F.xxhash64(term, F.lit(1), F.lit(k)), F.xxhash64(term, F.lit(2), F.lit(k))
        for level in range(TOP_LEVEL + 1):
            kept = F.lit(0).cast("bigint")
            for j in range(_LANES):
                inside = _lane(drawn, j).bitwiseAND(F.lit((1 << 2 * level) - 1)) == 0
                kept = kept.bitwiseOR(F.when(inside, F.shiftleft(_lane(value, j), _LANE * j)).otherwise(F.lit(0).cast("bigint")))
            out.append(kept.alias(f"x{level}_{k}"))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """(o, d, h, text): order of the documents (a null id first), hash of the text, text with null as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").isNotNull().cast("int").alias("o"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))


def fit_lexicon(rows: DataFrame, keys: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, x<level>_<k> ...) of the band. ``rows``: (o, d, h, text); ``keys``: (o, d, h), the same rows. The frequencies are over all
    documents; of a text with very many copies the one with the least id counts."""
    total = keys.count()
    copies = keys.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("o", "d")).alias("first"))
    heavy = stored(copies.where(F.col("n") > max(1.0, HEAVY * total)).select("h", "n", "first"), "heavy", 1)  # 1 / HEAVY rows at most
    counted = total - (heavy.agg(F.sum(F.col("n") - 1)).first()[0] or 0)
    met = rows.join(F.broadcast(heavy.select("h", "first")), "h", "left").where(F.col("first").isNull() | (F.struct("o", "d") == F.col("first")))
    frequency = met.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    band = frequency.where((F.col("n") >= low * counted) & (F.col("n") <= max(high * counted, 1.0))).select("term")
    drawn = band.select("term", *_subsets(F.col("term")))
    every = rows.sparkSession.range(1).select(*[F.lit(_EVERY).cast("bigint").alias(c) for c in drawn.columns])
    return stored(drawn.unionAll(every), "lexicon")


def _met(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    fits = lexicon.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return terms.join(F.broadcast(lexicon) if fits else lexicon, "term")


def _text(parts: Column) -> Column:
    return F.concat_ws("", F.transform(parts, lambda p: F.lpad(F.lower(F.hex(p)), 5, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts of two fingerprints, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(REPLICATES))


def _fingerprinted(rows: DataFrame, keys: list[str], lexicon: DataFrame) -> DataFrame:
    """``keys``, which name a row of ``rows``, and the parts of its ``text``. Where ``rows`` is dealt by some of the keys, nothing
    is shuffled. A part without terms of the lexicon is a hash of the whole lower-case text."""
    # Computed before the explode, else once a term.
    listed = rows.select(*keys, F.xxhash64(F.lower("text")).alias("whole"), F.array_append(term_hashes(F.col("text")), F.lit(_EVERY).cast("bigint")).alias("terms"))
    each = listed.select(*keys, "whole", F.explode("terms").alias("term"))
    # ``_EVERY`` has 0 in all subsets and so changes no exclusive-or.
    got = _met(each, lexicon).groupBy(*keys, "whole").agg(*[F.bit_xor(c).alias(c) for c in lexicon.columns if c != "term"])
    parts = []
    for r in range(REPLICATES):
        k, j = divmod(r, _LANES)
        found = [F.when(_lane(F.col(f"x{level}_{k}"), j) != 0, _lane(F.col(f"x{level}_{k}"), j) + (level << _LANE)) for level in reversed(range(TOP_LEVEL + 1))]
        parts.append(F.coalesce(*found, _lane(F.xxhash64(F.lit(r), F.col("whole")), 0) + (_WHOLE << _LANE)).cast("int"))
    return got.select(*keys, F.array(*parts).alias("parts"))


def fingerprints(docs: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_hash, fingerprint) of each different (doc_id, text); equal texts have equal fingerprints."""
    rows = keyed(docs)
    if lexicon is None:
        lexicon = fit_lexicon(rows, stored(rows.select("o", "d", "h"), "keys"))
    got = _fingerprinted(rows, ["o", "d", "h"], lexicon)
    return got.select(F.when(F.col("o") == 1, F.col("d")).alias("doc_id"), F.col("h").alias("text_hash"), _text(F.col("parts")).alias("fingerprint"))


def _blocks(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with a block of neighbours in the order of the documents, and at the end of each block (``extra`` = 1) the first
    row of the next; the last block is followed by the first."""
    n = max(1, min(MOST_BLOCKS, -(-keys.count() // BLOCK_ROWS)))
    place = F.struct("o", "d", "h")
    firsts = keys.repartitionByRange(n, "o", "d", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(place).alias("first"))
    firsts = stored(firsts.select("first").distinct(), "firsts", 1)
    count = firsts.count()
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, math.ceil(math.log2(count + 1)))))])
    bounds = firsts.agg(F.sort_array(F.collect_list("first")).alias("bounds")).scalar()

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= count) & (F.try_element_at("bounds", at + by) <= F.col("place")), at + by).otherwise(at)

    placed = rows.withColumn("place", place).withColumn("bounds", bounds)
    placed = placed.withColumn("at", F.aggregate(steps, F.lit(0), step))
    first = F.try_element_at("bounds", F.col("at")) == F.col("place")
    home = F.struct((F.col("at") - 1).alias("block"), F.lit(0).alias("extra"))
    before = F.struct(F.pmod(F.col("at") - 2, F.lit(count)).alias("block"), F.lit(1).alias("extra"))
    dealt = F.explode(F.when(first, F.array(home, before)).otherwise(F.array(home)))
    return placed.select("o", "d", "h", "text", dealt.alias("b")).select("b.block", "b.extra", "o", "d", "h", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of ``docs``.

    The edited text has the last half of the code points (rounded down) replaced by the first as many, or all, of the next
    document. Documents follow one another by id, a null id first, rows of one id by a hash of their text; the last is followed
    by the first, a single one by itself. Null texts are empty. An empty table gives an empty table. A text without terms of
    the lexicon has the hash of its whole lower-case text as each part. Only ``doc_id`` and ``text`` are read.
    """
    rows = keyed(docs)
    keys = stored(rows.select("o", "d", "h"), "keys")
    if keys.isEmpty():
        schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
        return docs.sparkSession.createDataFrame([], schema)
    lexicon = fit_lexicon(rows, keys)
    order = Window.partitionBy("block").orderBy("extra", "o", "d", "h")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    lined = _blocks(rows, keys).withColumn("pos", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
    lined = lined.select("block", "pos", "extra", "o", "d", "text", F.concat(F.left("text", n - half), F.left("next", half)).alias("edited"), n.cast("bigint").alias("n_chars"))
    # Each row twice, first its own text, then the edited one.
    both = F.explode(F.when(F.col("extra") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("w")
    twice = lined.withColumn("edited_sha256", F.when(F.col("extra") == 0, F.sha2(F.col("edited"), 256))).select("*", both).withColumn("text", F.when(F.col("w") == 0, F.col("text")).otherwise(F.col("edited")))
    got = _fingerprinted(twice, ["block", "pos", "w", "extra", "o", "d", "n_chars", "edited_sha256"], lexicon)
    after = Window.partitionBy("block").orderBy("pos", "w")
    got = got.withColumn("edited_parts", F.lead("parts", 1).over(after)).withColumn("next_parts", F.lead("parts", 2).over(after)).where("extra = 0 and w = 0")
    return got.select(
        F.when(F.col("o") == 1, F.col("d")).alias("doc_id"), "n_chars", "edited_sha256", _text(F.col("parts")).alias("fingerprint"),
        _text(F.col("edited_parts")).alias("edited_fingerprint"), likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )
