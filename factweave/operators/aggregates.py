"""Agreement, consensus and roll-ups. What is not agreed on is null, and merging never raises a tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiers from the weakest to the strongest.
TIERS = ["speculative", "inferred", "cross_abi_corroborated", "proven"]


def tier_rank(tier: Column | str) -> Column:
    t = F.col(tier) if isinstance(tier, str) else tier
    out = F.lit(None).cast("int")
    for k, name in enumerate(TIERS):
        out = F.when(t == name, k).otherwise(out)
    return out


def tier_merge(df: DataFrame, keys: list[str], tier: str) -> DataFrame:
    """The weakest tier of each key."""
    names = F.array(*map(F.lit, TIERS))
    return df.groupBy(*keys).agg(F.min(tier_rank(tier)).alias("_r")).select(*keys, F.get(names, F.col("_r")).alias(tier))


def at_least(tier: Column | str, floor: str) -> Column:
    return tier_rank(tier) >= TIERS.index(floor)


def consensus(df: DataFrame, keys: list[str], partition: str, components: list[str], partitions: int) -> DataFrame:
    """A tier for each key: cross_abi_corroborated if two partitions or more have it and agree on every component, else inferred."""
    spread = [(F.min(c).eqNullSafe(F.max(c)) & (F.count(c) == F.count("*"))).alias(f"_a{k}") for k, c in enumerate(components)]
    out = df.groupBy(*keys).agg(F.count_distinct(partition).alias("present"), *spread)
    agree = F.lit(True)
    for k in range(len(components)):
        agree = agree & F.col(f"_a{k}")
    state = F.when(F.col("present") < 2, "unaligned").when(agree & (F.col("present") == partitions), "corroborated").when(agree, "partial").otherwise("disputed")
    tier = F.when(agree & (F.col("present") >= 2), "cross_abi_corroborated").otherwise("inferred")
    return out.select(*keys, "present", state.alias("state"), tier.alias("tier"))


def elect_or_null(df: DataFrame, keys: list[str], candidate: str) -> DataFrame:
    """The most frequent candidate of each key, null at a tie."""
    counts = df.groupBy(*keys, candidate).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    return counts.join(best, [*keys, "n"]).groupBy(*keys, "n").agg(F.when(F.count("*") == 1, F.min(candidate)).alias(candidate))


def elect_package(df: DataFrame, uri: str) -> DataFrame:
    """The application's package: of those with a main.dart at their top or two addresses, the one with main, then with most distinct addresses; a tie gives null.

    The framework's own packages do not stand for election.
    """
    package = F.regexp_extract(uri, "^package:([^/]*)", 1)
    counts = df.where(F.col(uri).startswith("package:")).select(package.alias("package"), F.col(uri).alias("uri")).distinct().where(~F.col("package").isin("flutter", "flutter_test"))
    main = F.col("uri") == F.concat(F.lit("package:"), "package", F.lit("/main.dart"))
    counts = counts.groupBy("package").agg(F.count("*").alias("n"), F.bool_or(main).alias("main")).where("main OR n >= 2")
    best = counts.agg(F.max(F.struct("main", "n")).alias("best"))
    tied = counts.join(F.broadcast(best), F.struct("main", "n") == F.col("best"))  # one row
    return tied.agg(F.when(F.count("*") == 1, F.min("package")).alias("package"))


def ownership(df: DataFrame, uri: str, application: str | None = None) -> DataFrame:
    """One row: how many distinct addresses are recognised, opaque, compact and the application's, and whether ownership is obfuscated.

    It is if eight or more are opaque and these are more than twice the recognised ones, and either some are the
    application's or eight or more, three in four of the opaque, are compact.
    """
    u = F.col(uri)
    known = u.rlike("^(dart:|package:|file:|org-dartlang-)")
    own = u.startswith(f"package:{application}/") if application else F.lit(False)
    counts = df.where(u != "").select(uri).distinct().agg(
        F.count_if(known).alias("recognised"), F.count_if(~known).alias("opaque"), F.count_if(~known & u.rlike(r"^[A-Za-z0-9_$]{1,8}\z")).alias("compact"), F.count_if(own).alias("application")
    )
    dominant = (F.col("opaque") >= 8) & (F.col("opaque") > 2 * F.col("recognised"))
    return counts.withColumn("obfuscated", dominant & ((F.col("application") > 0) | ((F.col("compact") >= 8) & (4 * F.col("compact") >= 3 * F.col("opaque")))))


def multiset_fingerprint(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A digest of each key's values; order does not count, multiplicity does."""
    joined = F.array_join(F.array_sort(F.collect_list(value)), ",")
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.sha2(joined.cast("binary"), 256).alias("fingerprint"))


def multiset_fold(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The 64-bit fold of each key's texts, bit by bit the one that other builds compare; null values count as nothing."""
    from ..functions.kernels import fold_64

    lists = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.collect_list(F.col(value).cast("string")).alias("_all"))
    return lists.select(*keys, fold_64("_all").alias("fold"))


def tri_state(flag: Column) -> Column:
    """true if all rows have it, false if none has it, null if some do."""
    return F.when(F.bool_and(flag), True).when(~F.bool_or(flag), False)


def constraint_solve(df: DataFrame, keys: list[str], supplied: str, flag: Column) -> DataFrame:
    """Distinct supplied values in order, their least and greatest, and whether all, none or some rows carry the flag."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(supplied)), "|").alias("supplied"), F.min(supplied).cast("long").alias("least"), F.max(supplied).cast("long").alias("most"), tri_state(flag).alias("needs"), F.count("*").alias("calls"))


#: Who settles a signature, the stronger first.
AUTHORITIES = ["vm_oracle", "retained_runtime_signature"]


def solve_signatures(calls: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """What is known of each signature: settled by the strongest authority, else bounded by the calls that were seen.

    calls: key, count, positional, type_args, named, all null for a call without a descriptor; known: key, authority, fixed.
    Calls give the distinct counts, at most how many positional ones are required, at least how many are taken, the names, the
    distinct numbers of type arguments, and whether all calls, none, or some (null) pass a descriptor.
    """
    names = calls.select(key, F.explode("named").alias("_name")).groupBy(key).agg(F.array_sort(F.collect_set("_name")).alias("named"))
    sums = calls.groupBy(key).agg(
        F.array_sort(F.collect_set("count")).alias("counts"), F.min("positional").alias("positional_at_most"), F.max("count").alias("capacity_at_least"),
        F.array_sort(F.collect_set("type_args")).alias("type_args"), tri_state(F.col("count").isNotNull()).alias("needs"), F.count("*").alias("calls"),
    )
    rank = F.array_position(F.array(*map(F.lit, AUTHORITIES)), F.col("authority"))
    settled = known.groupBy(key).agg(F.min_by(F.struct("authority", "fixed"), rank).alias("_best")).select(key, "_best.authority", "_best.fixed")
    joined = sums.join(names, key, "left").join(settled, key, "full")
    tier = F.when(F.col("authority").isNotNull(), "proven").when(F.col("calls").isNotNull(), "inferred")
    return joined.select(key, "authority", "fixed", "counts", "positional_at_most", "capacity_at_least", F.coalesce("named", F.array().cast("array<string>")).alias("named"), "type_args", "needs", "calls", tier.alias("tier"))


def propagate_agreeing(df: DataFrame, group: str, value: str, donor: Column) -> DataFrame:
    """Rows that are no donors get the value that all donors of their group agree on."""
    given = df.where(donor).groupBy(group).agg(F.min(value).alias("_low"), F.max(value).alias("_high")).where("_low = _high").select(group, F.col("_low").alias("_given"))
    return df.join(given, group, "left").withColumn("propagated", F.when(donor, F.col(value)).otherwise(F.col("_given"))).drop("_given")


def coverage(df: DataFrame, physical: list[str], order: list, conditions: dict[str, Column]) -> DataFrame:
    """Counts of logical rows and of distinct physical ranges; conditions count on logical rows and on the first row of each range.

    Each range is one row after the first aggregation, which is combined before its shuffle; nothing is sorted.
    """
    first = F.min_by(F.struct(*[c.alias(n) for n, c in conditions.items()]), F.struct(*order))
    ranges = df.groupBy(*physical).agg(F.count("*").alias("_n"), *[F.count_if(c).alias(n) for n, c in conditions.items()], first.alias("_first"))
    one = [F.sum("_n").alias("logical_rows"), F.count("*").alias("physical_rows")]
    for name in conditions:
        one += [F.sum(name).alias(name), F.count_if(F.col("_first")[name]).alias(f"{name}_physical")]
    return ranges.agg(*one)


def histograms(df: DataFrame, counted: dict[str, Column]) -> DataFrame:
    """histogram, value, n for several histograms of one table in one pass; null values are left out."""
    values = F.array(*[F.struct(F.lit(name).alias("histogram"), c.cast("string").alias("value")) for name, c in counted.items()])
    return df.select(F.explode(values).alias("v")).where("v.value IS NOT NULL").groupBy("v.histogram", "v.value").agg(F.count("*").alias("n"))


def group_peers(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Each distinct member with the other members of its key, in order."""
    sets = df.groupBy(*keys).agg(F.array_sort(F.collect_set(member)).alias("_all")).where(F.size("_all") > 1)
    return sets.select(*keys, F.explode("_all").alias(member), "_all").select(*keys, member, F.array_join(F.array_remove("_all", F.col(member)), "|").alias("peers"))


def peer_classes(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Each key with its distinct members in order and their number: the same as group_peers says, one row for a key instead of all pairs as text."""
    pairs = df.select(*keys, member).distinct()
    return pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(member)).alias("members"), F.count("*").alias("n")).where("n > 1")


def calibrate_bit(df: DataFrame, packed: str, expected: Column, low: int, high: int) -> DataFrame:
    """The one bit in low..high-1 that equals what is expected in every row; null if none or several do. One pass."""
    fits = [F.bool_and(F.coalesce(F.getbit(F.col(packed).cast("long"), F.lit(b)) == expected.cast("int"), F.lit(False))).alias(f"b{b}") for b in range(low, high)]
    hits = F.array_compact(F.array(*[F.when(F.col(f"b{b}"), F.lit(b)) for b in range(low, high)]))
    return df.agg(*fits).select(F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).cast("long").alias("bit"), F.size(hits).cast("long").alias("candidates"))
