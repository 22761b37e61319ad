"""The ordered admit chain, votes and verdicts, and chart votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules


def chain(steps: Sequence[tuple[str, Column, str]], otherwise: str = "drop") -> tuple[Column, Column]:
    """(verdict, step): of ordered (name, condition, verdict) the first whose condition is true."""
    verdict, name = F.lit(otherwise), F.lit(None).cast("string")
    for n, cond, v in reversed(list(steps)):
        verdict, name = F.when(cond, F.lit(v)).otherwise(verdict), F.when(cond, F.lit(n)).otherwise(name)
    return verdict, name


def admit_steps(keys: Column, pro_code: Column, lead_code: Column, whitelisted: Column, dropped: Sequence[str] = rules.KOREAN_DROPPED + rules.CHINESE_DROPPED) -> list[tuple[str, Column, str]]:
    """The catalogue's chain: any component on a drop list, a Korean number, a Japanese lead, a Japanese number, a
    number that the other source has. The order decides."""
    return [
        ("drop_list", F.arrays_overlap(keys, F.array(*[F.lit(x) for x in dropped])), "reject"),
        ("pro_kor", pro_code == "KOR", "reject"),
        ("artist", lead_code == "JPN", "admit"),
        ("pro", pro_code == "JPN", "admit"),
        ("rescue", whitelisted, "admit"),
    ]


def admits_to_whitelist(artist: Column) -> Column:
    """a name with kana, or one without Han and Hangul; not an empty one."""
    return (artist != "") & (artist.rlike(rules.KANA) | ~(artist.rlike(rules.HAN) | artist.rlike(rules.HANGUL)))


def tally(items: DataFrame, key: str, code: str) -> DataFrame:
    """A3: (key, jpn, kor, eng) counts of the codes; other codes count nothing."""
    return items.groupBy(key).agg(*[F.count_if(F.col(code) == c).alias(c.lower()) for c in ("JPN", "KOR", "ENG")])


def verdict(jpn: Column, kor: Column, eng: Column, least: int = rules.LEAST_VOTES, of_ten: int = rules.MAJORITY_OF_TEN) -> Column:
    """A4, in whole numbers: 7 of 10 is enough, at least three votes are needed."""
    both = jpn + kor
    return (
        F.when((jpn >= least) & (10 * jpn >= of_ten * both), "JPN")
        .when((kor >= least) & (10 * kor >= of_ten * both), "KOR")
        .when((jpn >= least) & (kor >= least), "AMBIGUOUS")
        .when((eng > 0) & (both == 0), "ENG")
        .otherwise("UNKNOWN")
    )


def chart_votes(rows: DataFrame, by: Sequence[str], number: str, least: int = rules.LEAST_VOTES) -> DataFrame:
    """A5: (by.., votes): distinct numbers of each group, of groups with at least so many."""
    return rows.groupBy(*by).agg(F.count_distinct(number).alias("votes")).where(F.col("votes") >= least)


def merge_votes(state: DataFrame, votes: DataFrame, as_: str, cap: int | None = None) -> DataFrame:
    """State (key, jpn, kor, eng) after chart votes (key, votes) for as_ (jpn or kor).

    A key with votes of another kind stays; else the larger count holds, capped if asked for. New keys come in.
    """
    other = "kor" if as_ == "jpn" else "jpn"
    j = state.join(votes, "key", "full_outer")
    now = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("jpn", "kor", "eng")}
    new = F.least(F.col("votes"), F.lit(cap)) if cap is not None else F.col("votes")
    takes = F.col("votes").isNotNull() & (now[other] == 0) & (now["eng"] == 0)
    now[as_] = F.when(takes, F.greatest(now[as_], new)).otherwise(now[as_])
    return j.select("key", *[now[c].alias(c) for c in ("jpn", "kor", "eng")])


def is_fresh(seen: Column, now: Column, days: int) -> Column:
    """seen is less than days before now; missing or unreadable is stale."""
    age = F.unix_millis(now.cast("timestamp")) - F.unix_millis(seen.cast("timestamp"))
    return F.coalesce(age < F.lit(days * 86_400_000), F.lit(False))


def refresh(state: DataFrame, fetched: DataFrame, key: str, now: Column, days: int) -> DataFrame:
    """State after a fetch: stale and missing keys take the fetched row, fresh ones and unanswered ones stay.
    Both have the same columns, last_seen among them."""
    stale = state.where(~is_fresh(F.col("last_seen"), now, days))
    fresh = state.where(is_fresh(F.col("last_seen"), now, days))
    come = fetched.join(fresh.select(key), key, "left_anti")
    return fresh.unionByName(come).unionByName(stale.join(come.select(key), key, "left_anti"))


def trailing_weeks(spark, now: str, weeks: int) -> DataFrame:
    """(week, first, last): seven-day windows that end at now, one day apart from each other."""
    i = F.col("week").cast("int")
    day = F.lit(now).cast("date")
    return spark.range(weeks).withColumnRenamed("id", "week").select("week", F.date_sub(day, i * 7 + 6).alias("first"), F.date_sub(day, i * 7).alias("last"))


def keep_stats(classified: DataFrame) -> DataFrame:
    """(verdict, step, n)."""
    return classified.groupBy("verdict", "step").agg(F.count("*").alias("n"))
