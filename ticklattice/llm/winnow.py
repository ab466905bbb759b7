"""Operator 6, document fingerprints by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a packed value that hold the position of its k-gram, counted back from the largest.
POSITION_BITS = 27


def _bind(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _turned(h: Column, n: int) -> Column:
    """The bits of a long turned left by n."""
    return F.shiftleft(h, n).bitwiseOR(F.shiftrightunsigned(h, 64 - n)) if n % 64 else h


def rolling_hashes(words: Column, k: int) -> Column:
    """Cyclic-polynomial hashes of the runs of k words: every word is hashed once, and a run's hash is the XOR of its words'
    hashes, each turned by how far it is from the end. That is what turning the last run's hash, taking the leaving word out
    and the entering one in gives; for a few words the sum itself is as short. Fewer than k words make one run."""

    def of(hs: Column) -> Column:
        n = F.size(hs) - (k - 1)
        out = F.slice(hs, 1, n)
        for j in range(1, k):
            out = F.zip_with(out, F.slice(hs, j + 1, n), lambda a, h: _turned(a, 1).bitwiseXOR(h))
        short = F.array(F.aggregate(hs, F.lit(0).cast("long"), lambda a, h: _turned(a, 1).bitwiseXOR(h)))
        return F.when(F.size(hs) >= k, out).otherwise(short)

    return _bind(F.transform(words, lambda w: F.xxhash64(w)), of)


def rolling_least(hs: Column, n: int) -> Column:
    """The least of every n neighbours (of all, if there are fewer): minima over 2, 4, 8 ... neighbours are made of those over
    half as many, so a place costs the logarithm of n."""

    def pairs(x: Column, step: int) -> Column:
        return _bind(x, lambda y: F.zip_with(F.slice(y, 1, F.size(y) - step), F.slice(y, step + 1, F.size(y) - step), lambda a, b: F.least(a, b)))

    out, width = hs, 1
    while width < n:
        step = min(width, n - width)
        out, width = pairs(out, step), width + step
    return F.when(F.size(hs) <= n, F.array(F.array_min(hs))).otherwise(out)


def winnow(text: Column, k: int, window: int) -> Column:
    """Packed values (hash << POSITION_BITS | largest - position) that winnowing of k-word grams selects, in text order.

    Words are runs of other than [\\x20\\x09-\\x0D], lower-cased; fewer than k words make one gram, none make none. Of
    every `window` consecutive rolling hashes the least is selected, of equal ones the rightmost (the packed position counts
    down, so the least packed value is just that); a text of no more hashes than that has one. Any run of window + k - 1
    words that two texts share selects a common hash.
    """
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    last = (1 << POSITION_BITS) - 1

    def packed(hs: Column) -> Column:
        return F.transform(hs, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, POSITION_BITS + 1), POSITION_BITS).bitwiseOR((F.lit(last) - i).cast("long")))

    some = _bind(words, lambda ws: F.when(F.size(ws) > 0, _bind(packed(rolling_hashes(ws, k)), lambda hs: F.array_distinct(rolling_least(hs, window)))))
    return F.coalesce(some, F.array().cast("array<bigint>"))


def hashes(packed: Column) -> Column:
    return F.transform(packed, lambda x: F.shiftrightunsigned(x, POSITION_BITS))


def positions(packed: Column) -> Column:
    """Word positions of the selected grams: where a match found by their hashes lies."""
    last = (1 << POSITION_BITS) - 1
    return F.transform(packed, lambda x: F.lit(last).cast("long") - x.bitwiseAND(F.lit(last).cast("long")))


def as_text(packed: Column) -> Column:
    """hash@position of every selected gram, comma-separated."""
    return F.array_join(F.transform(packed, lambda x: F.lower(F.hex(x))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of the selected hashes, 0 to 1; two empty fingerprints are alike."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, window: int = 4, parts: int | None = None) -> DataFrame:
    """id, text, packed (its winnowing), and next_text and next_packed of the next document by descending id.

    After the last document comes the first; null ids come last; equal ids stand in the order of a hash of their texts,
    then of the texts; a single document is its own next; null texts count as empty. Documents are dealt by ranges of their
    ids and neighbours meet in a window over one range; the last of a range takes the head of the next range, of which
    there is one row a range. An id (or null) that fills several ranges is dealt out by ranges of the hash. Ids are integers.
    Only texts are shuffled; each is winnowed once, where it meets its neighbour.
    """
    parts = parts or 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    at = [i / parts for i in range(1, parts)]
    seen = src.select(F.percentile_approx("id", at, 10_000).alias("p"), F.count("id").alias("n"), F.count(F.lit(1)).alias("m")).first() if at else None
    cuts = list((seen and seen.p) or [])  # one value for each part
    many = {c: cuts.count(c) for c in cuts if cuts.count(c) > 1}
    cuts = sorted(set(cuts))
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    # how many cuts are not below the id, so that parts ascend as ids descend
    part = F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(bounds, lambda c: c >= F.col("id"))))
    nulls = max(1, -(-(seen.m - seen.n) * parts // seen.m)) if seen and seen.m else 1
    split = F.when(F.col("id").isNull(), F.lit(nulls)).otherwise(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("id")), F.lit(1)) if many else F.lit(1))
    tie = F.shiftrightunsigned(F.xxhash64("text"), 1)
    # the rows of a cut that fills ranges stand apart, before those of the lesser ids of its part
    own = F.array_contains(F.array(*map(F.lit, many)), F.col("id")) if many else F.lit(False)
    dealt = src.withColumns({"tie": tie, "part": 2 * part + 1 - F.coalesce(own, F.lit(False)).cast("int"), "sub": F.least(F.floor(tie / 2.0**63 * split), split - 1).cast("int")})
    order = [F.col("id").desc_nulls_last(), F.col("tie"), F.col("text")]
    first = F.struct(F.col("id").isNull().alias("a"), (-F.col("id")).alias("b"), "tie")
    tops = dealt.groupBy("part", "sub").agg(F.min(first).alias("top"))
    heads = dealt.withColumn("top", first).join(F.broadcast(tops), ["part", "sub", "top"]).groupBy("part", "sub").agg(F.min("text").alias("head"))
    ring = Window.orderBy("part", "sub")  # one row for each range
    after = F.coalesce(F.lead("head").over(ring), F.first("head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("part", "sub", after.alias("head"))
    heads = heads.withColumn("head_packed", winnow(F.col("head"), k, window))
    mine = dealt.repartition("part", "sub").withColumn("packed", winnow(F.col("text"), k, window))
    lead = F.lead(F.struct("text", "packed")).over(Window.partitionBy("part", "sub").orderBy(*order))
    return mine.withColumn("nxt", lead).join(heads, ["part", "sub"], "left").select(
        "id", "text", "packed", F.coalesce("nxt.text", "head").alias("next_text"), F.coalesce("nxt.packed", "head_packed").alias("next_packed")
    )


def edited_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, window: int = 4) -> DataFrame:
    """One row a document: its fingerprint, that of the text whose last half (floor(n_chars / 2) code points) gives way to
    the first as many of the next document, and the likeness of its fingerprint to the edited text's and the next one's.

    Every text is fingerprinted whole. Empty and null
    texts have an empty fingerprint and are alike to each other only; repeated rows give repeated results; an empty table
    gives an empty result; other columns are ignored.
    """
    t = with_next(docs, id_col=id_col, text_col=text_col, k=k, window=window)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    t = t.withColumns({"n_chars": n.cast("long"), "edited": edited}).withColumn("edited_packed", winnow(F.col("edited"), k, window))
    own, other, nxt = hashes(F.col("packed")), hashes(F.col("edited_packed")), hashes(F.col("next_packed"))
    return t.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("packed")).alias("fingerprint"),
        as_text(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"),
        likeness(own, nxt).alias("near_next"),
    )
