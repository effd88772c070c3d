"""Names of a block that are alike by the Ratcliff-Obershelp ratio, without comparing all pairs of the block.

A ratio of ``t`` between names of ``a`` and ``b`` characters takes ``M >= t * (a + b) / 2`` characters in common. They lie
in runs that at least one of the other ``a + b - 2 * M`` characters parts from the next, so names have at least
``3 * M - (a + b) - 1`` pairs of neighbouring characters in common too. Each name is therefore indexed by as few of its
rarest tokens (neighbouring characters, for short names single ones) as any name that is alike must meet: pairs that share
none of these cannot reach ``t``, and no other pair is left out. Only distinct names are compared.

Where all names of a large block share even their rarest tokens, segments part them better. At most ``d = (1 - t) * (a + b)``
characters of two alike names are not in common, and each lies in one segment of the shorter name at most. So if that is
cut into ``d + 1`` segments, the longer name has one of them unchanged, moved by no more than the characters that it has
more before it. Both ways find every pair; a block takes the one that meets fewer.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.operators.resolution import block_pairs
from cairnlake.sources.scratch import stored

#: Blocks whose names meet more others than this by their tokens, on average, are looked at by segments too.
MANY_MET = 16
#: Names that meet one segment in a task.
SEGMENT_PART = 1000


def _ceil(value: Column) -> Column:
    return F.ceil(value - 1e-9)


def index_tokens(names: DataFrame, least: float) -> DataFrame:
    """(block, name, token): the rarest tokens of the names of (block, name), as many as the ratio asks for."""
    ratio = least / (2 - least)  # the shortest partner's length, as a share of a name's
    slope = 1.5 * least - 1
    #: Names of so many characters have at least one pair of neighbours in common with every other such name that is alike.
    enough = math.ceil(1 / slope + 1e-9) if slope > 0 else None
    long = F.length("name") >= enough if enough else F.lit(False)
    beside_short = F.length("name") <= (enough - 1) / ratio + 1e-9 if enough else F.lit(True)
    n = F.length("name")
    grams = lambda width: F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.substring("name", i, F.lit(width)))
    none = F.array().cast("array<string>")
    every = F.concat(F.when(long, grams(2)).otherwise(none), F.when(beside_short | ~long, grams(1)).otherwise(none))
    counted = names.select("block", "name", F.explode(every).alias("gram")).groupBy("block", "name", "gram").agg(F.count(F.lit(1)).alias("times"))
    tokens = stored(counted.select("block", "name", F.length("gram").alias("width"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"), "gram").select("block", "name", "width", F.concat_ws(":", "gram", "nth").alias("token")), "tokens")
    rare = tokens.groupBy("block", "token").agg(F.count(F.lit(1)).alias("names"))
    ranked = tokens.join(rare, ["block", "token"]).groupBy("block", "name", "width").agg(F.sort_array(F.collect_list(F.struct("names", "token"))).alias("ranked"))
    common = F.when(F.col("width") == 1, _ceil(n * ratio)).otherwise(F.greatest(_ceil(slope * n * (1 + ratio) - 1), F.lit(1)))
    first = F.slice("ranked", F.lit(1), F.greatest(F.size("ranked") - common + 1, F.lit(1)).cast("int"))
    return ranked.select("block", "name", F.explode(F.transform(first, lambda x: x["token"])).alias("token"))


def segment_keys(names: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(block, name, key) of names as the shorter of two and as the longer one (or either, of equal lengths): alike names have a key in common."""
    sized = names.select("block", "name", F.length("name").alias("n"))
    both = sized.join(sized.select("block", F.col("n").alias("m")).distinct(), "block")  # a block has few lengths

    def cut(a: str, b: str, texts: Callable[[Column, Column, Column], Column]) -> DataFrame:
        most = F.floor(F.lit(1 - least) * (F.col(a) + F.col(b)) + 1e-9).cast("int")
        pairs = both.where(F.col(a) <= F.col(b)).withColumn("d", most - F.pmod(F.col(a) + F.col(b) - most, F.lit(2))).where(F.col("d") >= F.col(b) - F.col(a))
        at = lambda i: F.floor(i * F.col(a) / (F.col("d") + 1)).cast("int")
        segments = F.flatten(F.transform(F.sequence(F.lit(0), F.col("d")), lambda i: F.transform(texts(i, at(i), at(i + 1) - at(i)), lambda text: F.concat_ws(":", a, b, i, text))))
        return pairs.select("block", "name", F.explode(F.array_distinct(segments)).alias("key"))

    def moved(_: Column, start: Column, width: Column) -> Column:
        back, on = F.col("d") - (F.col("n") - F.col("m")), F.col("d") + (F.col("n") - F.col("m"))
        places = F.sequence(F.greatest(start - F.floor(back / 2).cast("int"), F.lit(0)), F.least(start + F.floor(on / 2).cast("int"), F.col("n") - width))
        return F.transform(places, lambda place: F.substring("name", place + 1, width))

    return cut("n", "m", lambda _, start, width: F.array(F.substring("name", start + 1, width))), cut("m", "n", moved)


def _by_segments(names: DataFrame, many: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(block) of those of ``many`` (block, pairs) where segments meet fewer pairs, and (block, left, right) that they meet there."""
    shorter, longer = (stored(keys, "segments") for keys in segment_keys(names.join(many, "block", "left_semi"), least))
    n = lambda keys, name: keys.groupBy("block", "key").agg(F.count(F.lit(1)).alias(name))
    common = stored(n(shorter, "l").join(n(longer, "r"), ["block", "key"]), "common-segments")
    met = common.groupBy("block").agg(F.sum(F.col("l").cast("double") * F.col("r")).alias("met"))
    fewer = stored(many.join(met, "block", "left").where(F.coalesce("met", F.lit(0.0)) < F.col("pairs")).select("block"), "by-segments")
    parts = common.join(fewer, "block", "left_semi").select("block", "key", F.ceil(F.col("r") / SEGMENT_PART).cast("int").alias("parts"))
    left = shorter.join(parts, ["block", "key"]).select("block", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("name").alias("l"))
    right = longer.join(parts, ["block", "key"]).select("block", "key", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"), F.col("name").alias("r"))
    # Of names of one length the smaller one counts as the shorter.
    both = left.join(right, ["block", "key", "part"]).where((F.length("l") < F.length("r")) | (F.col("l") < F.col("r")))
    return fewer, both.select("block", F.least("l", "r").alias("left"), F.greatest("l", "r").alias("right"))


def candidates(names: DataFrame, least: float) -> DataFrame:
    """(block, left, right), left < right: the pairs of different names of a block that may be alike."""
    tokens = stored(index_tokens(names, least), "index")
    per = tokens.groupBy("block", "token").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("block").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    many = stored(per.join(names.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "block").where(F.col("pairs") > MANY_MET * F.col("n")).select("block", "pairs"), "large-blocks")
    fewer, parted = (None, None) if many.isEmpty() else _by_segments(names, many, least)
    met = block_pairs(tokens if fewer is None else tokens.join(fewer, "block", "left_anti"), ["block", "token"], "name", keep_key=True)
    pairs = met.select("block", F.col("left_id").alias("left"), F.col("right_id").alias("right"))
    pairs = (pairs if parted is None else pairs.unionByName(parted)).distinct()
    a, b = F.length("left"), F.length("right")
    return pairs.where(2 * F.least(a, b) >= least * (a + b))


def both_ratios(least: float) -> Column:
    """struct(forth, back): the ratio with either name on the left, 0 where the characters in common don't suffice."""

    def ratios(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(left, right, strict=True):
            forth, back = SequenceMatcher(None, a, b), SequenceMatcher(None, b, a)
            rows.append((forth.ratio(), back.ratio()) if forth.quick_ratio() >= least else (0.0, 0.0))
        return pd.DataFrame(rows, columns=["forth", "back"], dtype="float64")

    return F.pandas_udf(ratios, T.StructType([T.StructField("forth", T.DoubleType()), T.StructField("back", T.DoubleType())]))("left", "right")


def alike(rows: DataFrame, block: str, id_col: str, name: str, least: float) -> DataFrame:
    """(block, left_id, right_id, ratio), left_id < right_id, of all rows of a block whose names reach ``least``; blank names don't."""
    own = rows.select(F.col(block).alias("block"), F.col(id_col).alias("id"), F.col(name).alias("name")).where("name <> ''").distinct()
    own = stored(own, "names")
    judged = candidates(own.select("block", "name").distinct(), least).withColumn("r", both_ratios(least))
    judged = stored(judged.select("block", "left", "right", "r.forth", "r.back").where((F.col("forth") >= least) | (F.col("back") >= least)), "alike-names")
    side = lambda x, c: own.select("block", F.col("name").alias(c), F.col("id").alias(x))
    ends = judged.join(side("one", "left"), ["block", "left"]).join(side("other", "right"), ["block", "right"]).where("one <> other")
    turned = F.col("one") < F.col("other")
    unlike = ends.select("block", F.least("one", "other").alias("left_id"), F.greatest("one", "other").alias("right_id"), F.when(turned, F.col("forth")).otherwise(F.col("back")).alias("ratio"))
    same = block_pairs(own, ["block", "name"], "id", keep_key=True).select("block", "left_id", "right_id", F.lit(1.0).alias("ratio"))
    return unlike.where(F.col("ratio") >= least).unionByName(same).groupBy(F.col("block").alias(block), "left_id", "right_id").agg(F.round(F.max("ratio"), 4).alias("ratio"))
