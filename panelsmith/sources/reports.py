"""Monthly figures out of published report texts, for the prose and the table layout.

White space is no help in printed texts, it stands anywhere.  So the fixed words
are looked up in the text without any, and what stands around them is read by
its place: the month in front, the figures behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words that layouts are told by, without white space.
HEADLINE, SHORT, SUBJECT, MOVES, REACHES, SINCE, PRIOR = "AverageWeekdayRidership", "(AWR)", "Caltrain", ("increased", "decreased"), "percentto", "from", "AWRof"
TOTAL, CHANGE = "TotalRidership", "%Change"
MONTHS = "january february march april may june july august september october november december".split()
WHITE = " \t\n\r\f\v\u00a0"
#: Characters read in front of and behind a headline.
REACH = 160
DATED, FIGURE = r"[A-Za-z]+\.?[0-9]{4}", r"^[0-9][0-9,]*"
_NUMBERS = {name: f"-{i:02d}" for i, m in enumerate(MONTHS, 1) for name in (m, m[:3])} | {"sept": "-09"}


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns worked out once a row, however often later expressions use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def month_key(dated: Column) -> Column:
    """``2019-03`` for letters that end in a month's name or its first three letters, and a year; null for others."""
    name = F.regexp_extract(F.lower(dated), f"((?:{'|'.join(m[:3] for m in MONTHS)})[a-z]*)\\.?[0-9]{{4}}$", 1)
    return F.concat(F.right(dated, F.lit(4)), F.try_element_at(F.create_map(*[F.lit(x) for kv in _NUMBERS.items() for x in kv]), name))


def number(text: Column) -> Column:
    return F.translate(text, ",*", "").try_cast("long")


def behind(text: Column, word: str, within: int) -> Column:
    """What stands behind the first ``word`` of a text, if that begins in the first ``within`` characters."""
    at = F.instr(text, F.lit(word))
    return F.when(at.between(1, within), F.substring(text, at + len(word), F.lit(REACH)))


def before_last(text: Column, word: str, within: int) -> Column:
    """What stands in front of the last ``word`` of a text, if that ends in the last ``within`` characters."""
    from_end = F.instr(F.reverse(text), F.lit(word[::-1]))
    return F.when(from_end.between(1, within), F.left(text, F.length(text) - from_end - (len(word) - 1)))


def _entry(month: Column, value: Column, rank: int) -> Column:
    return F.struct(month.alias("month"), value.alias("value"), F.lit(rank).alias("rank"))


def _prose(headlines: DataFrame, keys: list[str]) -> DataFrame:
    """A sentence: month, subject, headline, move, percentage, figure; then perhaps the month and figure of the year before."""
    h = once(headlines.where(F.startswith("_behind", F.lit(SHORT))), _moved=F.substring("_behind", F.lit(len(SHORT) + 1), F.lit(REACH)))
    h = h.where(F.col("_moved").startswith(MOVES[0]) | F.col("_moved").startswith(MOVES[1]))
    h = once(h, _reached=behind(F.col("_moved"), REACHES, 30), _when=before_last(F.col("_front"), SUBJECT, 60))
    h = once(h, _figure=F.regexp_extract("_reached", FIGURE, 0))
    h = once(h, _rest=F.substring("_reached", F.length("_figure") + 1, F.lit(REACH))).where(F.startswith("_rest", F.lit(SINCE)))
    h = once(h, _now=F.regexp_extract(F.rtrim("_when", F.lit(",")), f"{DATED}$", 0), _then=F.regexp_extract(F.substring_index("_rest", PRIOR, 1), f"{DATED}$", 0))
    now = _entry(month_key(F.col("_now")), number(F.col("_figure")), 0)
    then = _entry(month_key(F.col("_then")), number(F.regexp_extract(behind(F.col("_rest"), PRIOR, 40), FIGURE, 0)), 2)
    return h.select(*keys, F.inline(F.array(now, then))).withColumn("layout", F.lit("prose"))


def _table(reports: DataFrame, keys: list[str]) -> DataFrame:
    """A row of three figures and a change behind the headline, under the months that stand in front of the row of totals."""
    filled = F.filter(F.sequence(F.lit(1), F.size("_parts") - 1), lambda i: F.substring(F.get("_parts", i), 1, 1).between("0", "9"))
    t = once(reports, _at=F.get(filled, F.lit(0))).where("_at is not null")
    t = once(t, _pieces=F.split(F.array_join(F.slice("_parts", F.lit(1), F.col("_at")), HEADLINE), TOTAL)).where(F.size("_pieces") > 1)
    # Words, as they stand between blanks, up to the letter that ends the headline.
    letters = F.aggregate("_pieces", F.lit(0), lambda n, x: n + F.length(x)) + (F.size("_pieces") - 1) * len(TOTAL) + len(HEADLINE)
    t = once(t, _letters=letters, _words=F.split(F.trim(F.translate("_text", WHITE, " " * len(WHITE))), " +"))
    step = lambda a, w: F.when(a["letters"] < F.col("_letters"), F.struct((a["letters"] + F.length(w)).alias("letters"), (a["words"] + 1).alias("words"))).otherwise(a)
    t = once(t, _read=F.aggregate("_words", F.struct(F.lit(0).alias("letters"), F.lit(0).alias("words")), step)["words"])
    t = once(t, _row=F.slice("_words", F.col("_read") + 1, F.lit(5)), _head=F.get("_pieces", F.size("_pieces") - 2))
    word = lambda i: F.coalesce(F.get("_row", F.lit(i)), F.lit(""))
    whole = F.concat(word(3), word(4)).rlike(r"^-?[0-9.]+%") & F.forall(F.slice("_row", 1, 3), lambda w: w.rlike(r"^[0-9,]+\*?$")) & (F.size("_row") > 3)
    dated = lambda text: F.regexp_extract_all(text, F.lit(f"({DATED})"))
    t = once(t.where(whole), _months=dated(F.col("_head")), _columns=before_last(F.col("_head"), CHANGE, REACH))
    t = once(t, _titles=dated(F.col("_columns")))
    t = once(t, _three=F.when(F.size("_titles") > 2, F.slice("_titles", -3, 3)))
    titled = F.col("_columns").endswith(F.array_join("_three", ""))
    column = lambda i: F.when(titled, month_key(F.get("_three", F.lit(i))))
    entries = F.array(_entry(month_key(F.try_element_at("_months", F.lit(-1))), number(word(2)), 0), *[_entry(column(i), number(word(i)), 2) for i in (0, 1)])
    return t.select(*keys, F.inline(entries)).withColumn("layout", F.lit("table"))


def figures(reports: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """(keys, month, value, rank, layout): every monthly figure a report prints.

    Rank 0 is the headline, 2 a prior-year comparison.
    """
    keys = keys or ["url"]
    r = once(reports.select(*keys, F.col(text).alias("_t0")), _text=F.col("_t0")).drop("_t0")
    r = once(r, _parts=F.split(F.translate("_text", WHITE, ""), HEADLINE)).where(F.size("_parts") > 1)
    around = lambda i: F.struct(F.right(F.get("_parts", i - 1), F.lit(REACH)).alias("_front"), F.left(F.get("_parts", i), F.lit(REACH)).alias("_behind"))
    headlines = r.select(*keys, F.inline(F.transform(F.sequence(F.lit(1), F.size("_parts") - 1), around)))
    return _prose(headlines, keys).unionByName(_table(r, keys)).where("month is not null and value is not null")


def choose(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, rank, error): best rank wins; at equal rank a table beats prose.

    Two values of one layout at the best rank are a conflict, reported as an
    error row instead of a value.
    """
    best = candidates.groupBy(*keys).agg(F.min("rank").alias("_best"))
    top = candidates.join(best, keys).where(F.col("rank") == F.col("_best"))
    g = top.groupBy(*keys).agg(
        F.min("_best").alias("rank"),
        F.count_distinct("value").alias("_nv"),
        F.count_distinct(F.when(F.col("layout") == "table", F.col("value"))).alias("_nt"),
        F.count_distinct(F.when(F.col("layout") == "prose", F.col("value"))).alias("_np"),
        F.max(F.when(F.col("layout") == "table", F.col("value"))).alias("_tv"),
        F.max("value").alias("_v"),
    )
    clash = (F.col("_nt") > 1) | (F.col("_np") > 1)
    value = F.when(~clash, F.coalesce("_tv", "_v"))
    return g.select(*keys, value.alias("value"), "rank", F.when(clash, "conflicting values").alias("error"))
