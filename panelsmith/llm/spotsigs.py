"""SpotSigs fingerprints with DataFrame functions only: chains of content words behind common-word anchors."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Common words of English, French, German and Spanish that start a spot and are left out of its chain.
ANCHORS = (
    "a an and are as at be by for from he in is it not of on or that the this to was with "
    "au aux avec ce dans de des du elle en est et la le les pas pour qui que sur un une "
    "auf das den der die ein eine im ist mit nicht sich und von zu "
    "como con el los las por se su y"
).split()
CHAIN = 2
_NULL_KEY = -(1 << 63)


def signatures(text: Column, anchors: list[str] | None = None, chain: int = CHAIN) -> Column:
    """The set of spot signatures of a text, as a sorted array of distinct 32-bit hashes.

    Words are lower-cased runs of letters and digits.  A spot is an anchor
    directly before a content word (of a run of anchors the last); its signature
    is the anchor and the next ``chain`` content words, anchors between them left
    out.  A text without a spot has one signature, its whole word sequence, so
    that the set is never empty and equal texts have equal sets.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    marked = F.concat(F.array_join(F.transform(words, lambda w: F.when(w.isin(*(anchors or ANCHORS)), F.concat(F.lit("*"), w)).otherwise(w)), " "), F.lit(" "))
    content = r"[^* ][^ ]* "
    spot = r"\*(?=([^ ]+ " + content + (r"(?:\*[^ ]+ )*+" + content) * (chain - 1) + "))"
    chains = F.transform(F.regexp_extract_all(marked, F.lit(spot), F.lit(1)), lambda m: _hash(F.regexp_replace(m, r"\*[^ ]+ ", "")))
    found = F.sort_array(F.array_distinct(chains))
    return F.when(F.size(found) > 0, found).otherwise(F.array(_hash(marked)))


def _hash(text: Column) -> Column:
    return F.shiftright(F.xxhash64(text), 32).cast("int")


def shown(sigs: Column) -> Column:
    """A fingerprint as a string: the signatures in order, comma-joined."""
    return F.array_join(sigs.cast("array<string>"), ",")


def pruned_jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 where the sizes alone keep it below ``least``, without comparing members."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(small < F.lit(least) * large, 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def spot_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``sigs``), one row per input row; a null text counts as empty."""
    return docs.select(F.col(id_col), signatures(F.coalesce(F.col(text_col), F.lit(""))).alias("sigs"))


def near_pairs(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs of texts whose sets have a Jaccard similarity of at least ``least``, and who has which set.

    Returns pairs (``a``, ``b``, ``similarity``) of class representatives, a < b,
    and membership (id, ``class_id``): documents with equal sets share a class,
    named by its smallest id, so copies are compared once and never expanded.

    Sets are partitioned by length so that a partner lies in the same or the
    next partition.  Within one, two sets can reach ``least`` only if they share
    a signature among the rarest |s| - ceil(least |s|) + 1 of each, so only those
    are joined; sizes prune what is left before members are compared.  Exact.
    """
    known = materialise(spot_fingerprints(docs, id_col, text_col), "spots")
    classes = materialise(known.groupBy("sigs").agg(F.min(id_col).alias("class_id")), "classes")
    members = known.join(classes, "sigs").select(id_col, "class_id")
    rarity = classes.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("n"))
    size = F.size("sigs")
    each = classes.select("class_id", F.explode("sigs").alias("sig"), size.alias("size")).join(rarity, "sig")
    ordered = each.groupBy("class_id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("all"))
    prefix = F.col("size") - F.ceil(F.col("size") * least).cast("int") + 1
    cell = F.floor(F.log(F.col("size").cast("double")) / math.log(1 / least) + 1e-9) if least < 1 else F.col("size").cast("long")
    rare = ordered.select("class_id", "size", cell.alias("cell"), F.explode(F.slice("all", 1, prefix)).alias("s")).select("class_id", "size", "cell", F.col("s.sig").alias("sig"))
    rare = materialise(rare, "rare")
    left = rare.select(F.col("class_id").alias("x"), F.col("size").alias("x_size"), F.col("cell").alias("x_cell"), "cell", "sig")
    left = left.union(left.withColumn("cell", F.col("cell") + 1))
    right = rare.select(F.col("class_id").alias("y"), F.col("size").alias("y_size"), "cell", "sig")
    some = left.join(right, ["cell", "sig"]).where((F.col("x_cell") < F.col("cell")) | (F.col("x") < F.col("y")))
    some = some.where(F.least("x_size", "y_size") >= F.lit(least) * F.greatest("x_size", "y_size")).select("x", "y").distinct()
    sets = classes.select("class_id", "sigs")
    scored = some.join(sets.toDF("x", "x_sigs"), "x").join(sets.toDF("y", "y_sigs"), "y").withColumn("similarity", pruned_jaccard(F.col("x_sigs"), F.col("y_sigs"), least))
    return scored.where(F.col("similarity") >= least).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity"), members


def with_next(docs: DataFrame, id_col: str, columns: list[str], bucket_rows: int = 64, most_buckets: int = 1 << 16) -> DataFrame:
    """``docs`` with ``next_<c>`` for each of ``columns``: the values of the row with the next id, after the last the first.

    Ids are cut into ranges at quantiles of the ids themselves; the first row of
    a range is also put at the end of the range before, so that each range is
    ordered on its own and no task sees more than one.  Null ids come first;
    repeated ids are ordered by ``columns``.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_KEY))
    keys = docs.select(key.alias("k"))
    n = max(1, keys.count())
    buckets = min(most_buckets, math.ceil(n / bucket_rows))
    at = [i / buckets for i in range(1, buckets)]
    found = keys.agg(F.min("k").alias("low"), F.percentile_approx("k", [*at, 1.0], 4 * buckets + 100).alias("cuts")).first()
    bounds = sorted({found.low, *(found.cuts or [])[:-1]}) if found.low is not None else [0]
    width = math.ceil(math.sqrt(len(bounds)))
    groups = [bounds[s : s + width] for s in range(0, len(bounds), width)]
    table = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    heads = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
    placed = docs.select("*", key.alias("_key")).withColumn("_group", F.size(F.filter(heads, lambda h: h <= F.col("_key"))))
    own = F.element_at(table, F.col("_group"))
    placed = placed.withColumn("_place", F.size(F.filter(own, lambda h: h <= F.col("_key"))))
    placed = placed.withColumn("_bucket", (F.col("_group") - 1) * width + F.col("_place") - 1)
    first = F.element_at(F.element_at(table, F.col("_group")), F.col("_place")) == F.col("_key")
    before = F.pmod(F.col("_bucket") - 1, F.lit(len(bounds)))
    twice = placed.select("*", F.posexplode(F.when(first, F.array("_bucket", before)).otherwise(F.array("_bucket"))).alias("_guest", "_range"))
    order = Window.partitionBy("_range").orderBy("_guest", "_key", *columns)
    led = twice.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return led.where("_guest = 0").drop("_key", "_group", "_place", "_bucket", "_guest", "_range")


def fingerprints_and_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    The edited text replaces the last floor(n / 2) code points by the first as
    many of the next document's.  Columns: id, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``,
    ``n_spots``, ``length_partition``.  Null texts count as empty; repeated rows
    give repeated rows; a lone row is its own next; other columns are not carried.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    led = with_next(source.withColumn("sigs", signatures(F.col("text"))), "id", ["text", "sigs"])
    n = F.char_length("text")
    tail = F.floor(n / 2).cast("int")
    edited = led.select("id", "sigs", "next_sigs", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail)).alias("edited"))
    edited = edited.withColumn("edited_sigs", signatures(F.col("edited")))
    return edited.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("sigs")).alias("fingerprint"), shown(F.col("edited_sigs")).alias("edited_fingerprint"),
        pruned_jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        pruned_jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").alias("n_spots"), F.floor(F.log(F.size("sigs").cast("double")) / math.log(1 / 0.8)).alias("length_partition"),
    )
