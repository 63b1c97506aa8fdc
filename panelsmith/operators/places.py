"""Matching free-text place names to a station dimension."""

from __future__ import annotations

import itertools
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import col
from ..functions.scalars import haversine_km

# Words dropped, words rewritten, and the similarity cutoff.
DROPPED = ["station", "bart", "the"]
REWRITTEN = {"street": "st", "avenue": "ave", "boulevard": "blvd", "saint": "st"}
FUZZY_CUTOFF = 0.88
# Latin letters with a stroke or of another shape, which Unicode does not decompose, and their plain letters.
STROKED = {"ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ŧ": "t", "ı": "i", "ɨ": "i", "ƀ": "b", "ǥ": "g"}


def _folded() -> dict[str, str]:
    """Every lower-case Latin letter whose decomposition begins with an ASCII letter, and that letter."""
    blocks = itertools.chain(range(0xC0, 0x250), range(0x1E00, 0x1F00))
    bases = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, blocks) if c == c.lower()}
    return {c: b for c, b in bases.items() if b.isascii() and b != c} | STROKED


FOLDED = _folded()


def tokens(text) -> Column:
    """Lower-case ASCII words, rewritten and without filler, in order."""
    plain = F.translate(F.lower(F.coalesce(col(text), F.lit(""))), "".join(FOLDED), "".join(FOLDED.values()))
    words = F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(DROPPED))
    mapping = F.create_map(*[F.lit(x) for kv in REWRITTEN.items() for x in kv])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(mapping, w), w))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _unique(pairs: DataFrame, query: str) -> DataFrame:
    """(query, station, n): the only candidate, or NULL when there are several."""
    g = pairs.groupBy(query).agg(F.count_distinct("station").alias("n"), F.min("station").alias("_s"))
    return g.select(query, F.when(F.col("n") == 1, F.col("_s")).alias("station"))


def _chars(text: Column, length: Column) -> Column:
    """Characters numbered by occurrence ('a1', 'a2', ...): their overlap bounds the similarity."""
    letters = F.split(text, "")
    at = F.sequence(F.lit(1), length)
    return F.transform(at, lambda i: F.concat(F.element_at(letters, i), F.size(F.filter(F.slice(letters, 1, i), lambda c: c == F.element_at(letters, i))).cast("string")))


def fuzzy_candidates(queries: DataFrame, dim: DataFrame, q: str, d: str, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """All pairs that can reach the cutoff, without comparing everything with everything.

    ratio = 2M / (a + b) >= cutoff needs at least (cutoff / (2 - cutoff)) of a's
    characters in common.  Two strings that share that many must share one of
    the first few characters in rare-first order, so an equi-join on those finds
    every pair; the exact ratio decides later.
    """
    share = cutoff / (2 - cutoff)

    def prefix(df, c, out):
        n = F.length(c)
        sized = df.select(c).distinct().where(n > 0).withColumn("_ch", F.explode(_chars(F.col(c), n)))
        return sized.withColumnRenamed(c, out)

    left, right = prefix(queries, q, "_q"), prefix(dim, d, "_d")
    freq = left.select("_ch").unionByName(right.select("_ch")).groupBy("_ch").agg(F.count(F.lit(1)).alias("_f"))

    def firsts(df, c):
        ranked = df.join(freq, "_ch").groupBy(c).agg(F.sort_array(F.collect_list(F.struct("_f", "_ch"))).alias("_l"))
        n = F.size("_l")
        keep = n - F.ceil(n * share - 1e-9).cast("int") + 1
        return ranked.select(c, F.explode(F.transform(F.slice("_l", 1, keep), lambda s: s["_ch"])).alias("_ch"))

    pairs = firsts(left, "_q").join(firsts(right, "_d"), "_ch").select("_q", "_d").distinct()
    fits = (F.least(F.length("_q"), F.length("_d")) * 2.0) >= (F.length("_q") + F.length("_d")) * (cutoff - 1e-9)
    return pairs.where(fits)


def _nested(queries: DataFrame, dim: DataFrame, name: str) -> DataFrame:
    """(name, station): the only station whose words hold all of the name's or lie all within them, NULL for several.

    Names meet in the rarest word of the smaller one, so a word that a third of all names use is no key unless it is
    all that a name says.  Then every station with it is meant, and one row a word tells whether that is one.
    """
    qw = queries.select(name, F.array_distinct("_qt").alias("_q"))
    dw = dim.where(F.size("_dt") > 0).select("station", F.array_distinct("_dt").alias("_d"))
    at_word = dw.select("station", "_d", F.explode("_d").alias("_w"))
    words = at_word.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"), F.min("station").alias("_s"), F.max("station").alias("_e"))

    def rarest(df, key, column):
        """Each row with the word of ``column`` that fewest stations have; rows with a word that none has go."""
        each = df.select(*key, column, F.explode(column).alias("_w")).join(words.select("_w", "_n"), "_w")
        best = each.groupBy(*key, column).agg(F.min_by("_w", F.struct("_n", "_w")).alias("_w"), F.count(F.lit(1)).alias("_k"))
        return best.where(F.col("_k") == F.size(column)).drop("_k")

    alone = qw.where(F.size("_q") == 1).select(name, F.get("_q", F.lit(0)).alias("_w")).join(words, "_w").select(name, F.explode(F.array_distinct(F.array("_s", "_e"))).alias("station"))
    several = qw.where(F.size("_q") > 1)
    inside = rarest(several, [name], "_q").join(at_word, "_w").where(F.size(F.array_except("_q", "_d")) == 0).select(name, "station")
    around = several.withColumn("_w", F.explode("_q")).join(rarest(dw, ["station"], "_d"), "_w").where(F.size(F.array_except("_d", "_q")) == 0).select(name, "station")
    return _unique(alone.unionByName(inside).unionByName(around).distinct(), name)


def match_places(queries: DataFrame, dim: DataFrame, name: str, code: str, label: str, aliases: dict[str, str] | None = None, fuzzy: bool = True) -> DataFrame:
    """(name, station, tier) per distinct query name; ambiguous or unknown names give NULL.

    Tiers in order: alias of a station in ``dim``, same tokens, one name's words inside the other's,
    closest spelling.  A tier with several candidates ends the search.
    """
    q = queries.select(name).distinct().withColumn("_qt", tokens(name)).withColumn("_key", F.array_join("_qt", " "))
    d = dim.select(F.col(code).cast("string").alias("station"), tokens(label).alias("_dt")).withColumn("_key", F.array_join("_dt", " "))
    known = [F.lit(x) for kv in (aliases or {"": ""}).items() for x in kv]
    # An empty name has no answer; it is tier "none" from the start.
    meant = F.when(F.col("_key") != "", F.try_element_at(F.create_map(*known), F.col("_key")))
    codes = d.select(F.col("station").alias("_alias")).distinct().withColumn("_known", F.lit(True))
    # An alias counts only if its station is in the dimension.
    q = q.withColumn("_alias", meant).join(codes, "_alias", "left").withColumn("_alias", F.when(F.col("_known"), F.col("_alias"))).drop("_known")
    live = q.where((F.col("_key") != "") & F.col("_alias").isNull())

    exact = live.join(d, "_key").groupBy(name).agg(F.count_distinct("station").alias("_n"), F.min("station").alias("station")).where("_n = 1").select(name, "station")
    rest = live.join(exact, name, "left_anti")
    nested = _nested(rest, d, name)
    out = (
        q.where("_alias is not null").select(name, F.col("_alias").alias("station"), F.lit("alias").alias("tier"))
        .unionByName(exact.withColumn("tier", F.lit("exact")))
        .unionByName(nested.withColumn("tier", F.lit("subset")))
    )
    if fuzzy:
        left = rest.join(nested, name, "left_anti")
        pairs = fuzzy_candidates(left.select("_key"), d.select("_key"), "_key", "_key").withColumn("ratio", similarity("_q", "_d")).where(F.col("ratio") >= FUZZY_CUTOFF)
        scored = left.select(name, "_key").join(pairs, F.col("_key") == F.col("_q")).drop("_key").join(d.select("station", F.col("_key").alias("_d")), "_d")
        best = scored.groupBy(name).agg(F.max("ratio").alias("_top"))
        top = scored.join(best, name).where(F.col("ratio") == F.col("_top"))
        out = out.unionByName(_unique(top, name).withColumn("tier", F.lit("fuzzy")))
    return q.select(name).join(out, name, "left").withColumn("tier", F.coalesce("tier", F.lit("none")))


def normal_text(c, suffix: str = ", San Francisco Bay Area, CA") -> Column:
    text = F.replace(F.lower(col(c)), F.lit(suffix.lower()), F.lit(""))
    return F.trim(F.regexp_replace(text, r"[\s,]+", " "))


def same_place_text(a, b) -> Column:
    return normal_text(a) == normal_text(b)


def same_place_points(lat1, lng1, lat2, lng2, metres: float = 150.0) -> Column:
    return F.coalesce(haversine_km(lat1, lng1, lat2, lng2, 6371.0) * 1000 <= metres, F.lit(False))


# The service area as latitude / longitude boxes.
REGION_BOXES = [(37.1, 38.5, -123.6, -121.55), (38.5, 38.9, -123.6, -122.0), (36.9, 37.1, -121.75, -121.4)]


def in_region(lat, lng, boxes: list[tuple] = REGION_BOXES) -> Column:
    la, lo = col(lat), col(lng)
    hit = F.lit(False)
    for a, b, c, d in boxes:
        hit = hit | (la.between(a, b) & lo.between(c, d))
    return F.coalesce(hit & ~F.isnan(la) & ~F.isnan(lo), F.lit(False))
