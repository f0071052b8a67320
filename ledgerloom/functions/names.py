"""Party-name normalisation and an exact token-overlap similarity join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: company-form words left out of a comparison
DROPPED_WORDS = r"\bpvt\b|\bltd\b|\blimited\b|\bprivate\b|\bllp\b"


def normalise_name(name: Column) -> Column:
    n = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), DROPPED_WORDS, "")
    n = F.regexp_replace(n, r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(n, r"\s+", " "))


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalise_name(name), " "), lambda t: t != ""))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger token set; 0 when either is empty."""
    big = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)).cast("double") / big)


def name_similarity(a: Column, b: Column) -> Column:
    return token_overlap(name_tokens(a), name_tokens(b))


def fuzzy_pairs(left: DataFrame, right: DataFrame, keys: list[str], name: str, threshold: float = 0.5) -> DataFrame:
    """All (left name, right name) pairs within ``keys`` whose overlap exceeds ``threshold``.

    Exact, by prefix filtering: two sets that share more than t * max(|x|, |y|)
    tokens must share one among the |x| - floor(t|x|) rarest tokens of x (and
    likewise of y).  Only those rare tokens are joined, so a word that a third
    of all names carry ("traders") brings no candidates of its own; every
    candidate is then verified on the full sets.
    """
    def sets(df: DataFrame, out: str) -> DataFrame:
        return (df.select(*keys, F.col(name).alias(out)).distinct()
                .withColumn("tokens", name_tokens(F.col(out))).filter(F.size("tokens") > 0))

    lset, rset = sets(left, "left_name"), sets(right, "right_name")

    def distinct_sets(df: DataFrame) -> DataFrame:
        return df.select(*keys, F.array_sort("tokens").alias("tokens")).distinct()

    lu, ru = distinct_sets(lset), distinct_sets(rset)
    tokens = lu.unionByName(ru).select(*keys, F.explode("tokens").alias("token"))
    freq = tokens.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))

    def prefix(df: DataFrame, out: str) -> DataFrame:
        each = df.select(*keys, "tokens", F.explode("tokens").alias("token")).join(freq, [*keys, "token"])
        # one token list per name: bounded by the length of a name
        ranked = each.groupBy(*keys, "tokens").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("by_rarity"))
        keep = F.size("tokens") - F.floor(F.size("tokens") * F.lit(threshold)).cast("int")
        rare = F.transform(F.slice("by_rarity", F.lit(1), keep), lambda s: s["token"])
        return ranked.select(*keys, F.col("tokens").alias(out), F.explode(rare).alias("token"))

    cand = prefix(lu, "lt").join(prefix(ru, "rt"), [*keys, "token"]).select(*keys, "lt", "rt").distinct()
    good = cand.withColumn("similarity", token_overlap(F.col("lt"), F.col("rt"))).filter(F.col("similarity") > threshold)
    return (
        good.join(lset.withColumn("lt", F.array_sort("tokens")).drop("tokens"), [*keys, "lt"])
        .join(rset.withColumn("rt", F.array_sort("tokens")).drop("tokens"), [*keys, "rt"])
        .select(*keys, "left_name", "right_name", "similarity"))
