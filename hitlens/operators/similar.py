"""MinHash signatures of paths, and an exact join of similar paths."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml.feature import MinHashLSH
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitlens.operators.features import PATH_GRAM, add_path_ngrams, hash_terms
from hitlens.session import land

MARKS = ("mark0", "mark1", "mark2", "mark3")


def minhash_signatures(
    df: DataFrame, terms: str, tables: int = 5, buckets: int = 16384, seed: int = 1
) -> DataFrame:
    """Columns ``min0`` .. of the set of ``terms``; NULL for rows without terms.

    MinHash is undefined on an empty set, so such rows are hashed with a filler
    term and then set to NULL: no row is lost and the table is read once.
    """
    filled = df.withColumn(
        "_terms", F.when(F.size(terms) > 0, F.col(terms)).otherwise(F.array(F.lit("")))
    )
    hashed = hash_terms(filled, "_terms", "_hashes", buckets)
    lsh = MinHashLSH(inputCol="_hashes", outputCol="_signature", numHashTables=tables, seed=seed)
    signed = lsh.fit(hashed).transform(hashed)
    minima = [
        F.when(F.size(terms) > 0, vector_to_array(F.col("_signature")[i])[0]).alias(f"min{i}")
        for i in range(tables)
    ]
    return signed.select(*df.columns, *minima)


# Pairs of similar sets


def path_sets(requests: DataFrame, gram: int = PATH_GRAM) -> DataFrame:
    """clean_path, requests, terms: every distinct path with its sorted set of character n-grams.

    Paths shorter than ``gram`` have an empty set, a missing path is left out. N-grams are made
    once per distinct path, not per request.
    """
    paths = requests.filter("clean_path IS NOT NULL").groupBy("clean_path")
    counted = add_path_ngrams(paths.agg(F.count(F.lit(1)).alias("requests")), gram)
    return counted.select("clean_path", "requests", F.array_sort(F.array_distinct("path_ngrams")).alias("terms"))


def _least_shared(size: Column, percent: int) -> Column:
    """Terms that a set shares at least with any set it is linked to."""
    return F.floor((size * percent + 99) / 100)


def _least_shared_longer(size: Column, percent: int) -> Column:
    """The same if the other set is not smaller."""
    return F.floor((size * 2 * percent + 99 + percent) / (100 + percent))


def _marks(terms: str) -> dict[str, Column]:
    """64 bits in each of ``MARKS`` columns, one per hash of a term: sets differ in at least as many terms as bits."""

    def with_bit(mark: Column, place: Column) -> Column:
        return mark.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")))

    places = F.transform(terms, lambda term: F.pmod(F.xxhash64(term), F.lit(64 * len(MARKS))))
    return {
        mark: F.aggregate(F.filter(places, lambda place: F.floor(place / 64) == k), F.lit(0).cast("long"), with_bit)
        for k, mark in enumerate(MARKS)
    }


def set_classes(sets: DataFrame, key: str, terms: str = "terms") -> DataFrame:
    """Stored table of the distinct non-empty sets: number, least key, size, marks, terms from rare to frequent.

    The frequency of a term is the number of sets it is in; equal ones are in order of text. Terms are numbers here,
    one per term, which compare faster than texts.
    """
    grouped = sets.filter(F.size(terms) > 0).groupBy(F.col(terms).alias("terms"))
    classes = grouped.agg(F.min(key).alias("least"))
    classes = land(classes.select(F.monotonically_increasing_id().alias("number"), "least", "terms"), "similar-classes")
    single = classes.select("number", F.explode("terms").alias("term"))
    often = single.groupBy("term").agg(F.count(F.lit(1)).alias("often"))
    often = land(often.select("*", F.monotonically_increasing_id().alias("code")), "similar-terms")
    ranked = single.join(often, "term").groupBy("number")
    # A list holds the terms of one set.
    ordered = ranked.agg(F.array_sort(F.collect_list(F.struct("often", "term", "code")))["code"].alias("ordered"))
    found = classes.join(ordered, "number").select("number", "least", F.col("ordered").alias("terms"))
    return land(found.withColumns({"size": F.size("terms").cast("long"), **_marks("terms")}), "similar-sets")


def meeting_classes(classes: DataFrame, percent: int) -> DataFrame:
    """large_number, small_number: every pair of sets that may be linked, once.

    Linked sets have a term in common among the first, rarest, ones of both, so only those meet. Of the
    smaller set fewer are needed, as the other is not smaller. At the first common term the rest of
    both sets must still suffice, and the marks must differ in few bits; both are tested inside the
    join, so a frequent term makes no rows of pairs that fail.
    """

    def first_terms(side: str, least: Column) -> DataFrame:
        first = F.slice("terms", F.lit(1), (F.col("size") - least + 1).cast("int"))
        rows = classes.select("number", "size", *MARKS, F.posexplode(first).alias("at", "term"))
        return rows.select("term", *[F.col(c).alias(f"{side}_{c}") for c in ("number", "size", *MARKS, "at")])

    size = F.col("size")
    large = first_terms("large", _least_shared(size, percent))
    small = first_terms("small", _least_shared_longer(size, percent))
    both = F.col("large_size") + F.col("small_size")
    differ = reduce(add, [F.bit_count(F.col(f"large_{mark}").bitwiseXOR(F.col(f"small_{mark}"))) for mark in MARKS])
    rest = F.least(F.col("large_size") - F.col("large_at"), F.col("small_size") - F.col("small_at"))
    follows = F.struct("small_size", "small_number") < F.struct("large_size", "large_number")
    met = large.join(small, "term").filter(
        follows
        & (F.col("small_size") * 100 >= F.col("large_size") * percent)
        & (rest * (100 + percent) >= both * percent)
        & ((both - differ) * (100 + percent) >= both * 2 * percent)
    )
    return met.select("large_number", "small_number").distinct()


def similar_classes(classes: DataFrame, percent: int = 75) -> DataFrame:
    """a, b, shared, total of all pairs of sets with ``100 * shared >= percent * total``.

    ``classes`` comes from ``set_classes``; a and b are least keys, a < b; shared and total are the sizes
    of intersection and union. Exact: pairs that meet are compared on whole sets. Adaptive
    execution splits the join of a hot term.
    """
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be from 1 to 100; it is {percent}")
    met = meeting_classes(classes, percent)
    for side in ("large", "small"):
        whole = classes.select(*[F.col(c).alias(f"{side}_{c}") for c in ("number", "least", "terms")])
        met = met.join(whole, f"{side}_number")
    shared = F.size(F.array_intersect("large_terms", "small_terms")).cast("long")
    total = F.size("large_terms") + F.size("small_terms") - F.col("shared")
    found = met.withColumn("shared", shared).withColumn("total", total)
    found = found.filter(F.col("shared") * 100 >= F.col("total") * percent)
    least = (F.col("large_least"), F.col("small_least"))
    return found.select(F.least(*least).alias("a"), F.greatest(*least).alias("b"), "shared", "total")


def similar_members(sets: DataFrame, key: str, links: DataFrame, terms: str = "terms") -> DataFrame:
    """``sets`` without its terms, with ``least`` (smallest key of an equal set) and ``n_links`` of that set.

    Keys of an empty set stand for themselves and have no links.
    """
    least = F.min(key).alias("least")
    classes = sets.filter(F.size(terms) > 0).groupBy(terms).agg(least)
    ends = links.select(F.explode(F.array("a", "b")).alias("least"))
    degrees = ends.groupBy("least").agg(F.count(F.lit(1)).alias("n_links"))
    known = sets.join(classes, terms, "left").join(degrees, "least", "left")
    rest = [c for c in sets.columns if c != terms]
    return known.select(*rest, F.coalesce("least", key).alias("least"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
