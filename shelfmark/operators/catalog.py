"""Catalogue queries: star joins, filters, pages by offset, seek and key, and set operations on selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from shelfmark.functions.arabic import fold_for_search
from shelfmark.operators import scans

#: A dimension below this many rows is broadcast, whatever Spark knows of its size.
BROADCAST_ROWS = 200_000
DEFAULT_LIMIT, MAX_LIMIT = 20, 100


def dimension(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint where the table is known or counted to be small; else the optimizer's choice."""
    return F.broadcast(df) if (df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows) <= BROADCAST_ROWS else df


def star(facts: DataFrame, *dims: tuple[DataFrame, str, str]) -> DataFrame:
    """Left joins of dimensions (table, key in the facts, key in the dimension); unmatched rows keep nulls."""
    for dim, own, other in dims:
        facts = facts.join(dim, facts[own] == dim[other], "left")
    return facts


def page(df: DataFrame, order: list[Column], number: int = 1, limit: int = DEFAULT_LIMIT, offset: int | None = None) -> DataFrame:
    """Rows of one page; an explicit offset goes before the page number. The order must end in a unique key."""
    if number < 1 or not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"page from 1, limit from 1 to {MAX_LIMIT}")
    return df.orderBy(*order).offset((number - 1) * limit if offset is None else offset).limit(limit)


def page_with_total(df: DataFrame, order: list[Column], number: int = 1, limit: int = DEFAULT_LIMIT, offset: int | None = None) -> DataFrame:
    """A page and, on each row, the number of rows of all pages and the number of pages."""
    total = df.agg(F.count("*").alias("total"))
    rows = page(df, order, number, limit, offset).crossJoin(F.broadcast(total))
    return rows.withColumn("pages", F.ceil(F.col("total") / limit).cast("bigint"))


def deep_page(df: DataFrame, order: list[str], offset: int, limit: int = DEFAULT_LIMIT, ranges: int = 256) -> DataFrame:
    """A page far into an ascending order whose last column is a unique key, without sorting what comes before it.

    Rows are counted by ranges of the first column; only those ranges that the page lies in are read again and sorted.
    """
    if offset < 0 or not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"offset from 0, limit from 1 to {MAX_LIMIT}")
    cuts = scans.cuts_of(df, order[0], ranges)
    dealt = scans.dealt(df, order[0], cuts=cuts)
    counts = {r[scans.RANGE]: r["count"] for r in dealt.groupBy(scans.RANGE).count().collect()}  # a row for each range
    before, first, last, skipped = 0, None, -1, 0
    for place in range(len(cuts) + 1):
        n = counts.get(place, 0)
        if before < offset + limit and before + n > offset:
            first, last, skipped = (place, place, offset - before) if first is None else (first, place, skipped)
        before += n
    if first is None:
        return df.limit(0)
    kept = dealt.where(F.col(scans.RANGE).between(first, last))
    if isinstance(df.schema[order[0]].dataType, NumericType):  # such bounds reach the scan
        kept = kept.where(F.col(order[0]) > cuts[first - 1]) if first else kept
        kept = kept.where(F.col(order[0]) <= cuts[last]) if first and last < len(cuts) else kept
    return kept.drop(scans.RANGE).orderBy(*order).offset(skipped).limit(limit)


def seek(df: DataFrame, key: str, start: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Rows from a key on, in its order, with the number of rows before it and of all rows."""
    counts = df.agg(F.count_if(F.col(key) < start).alias("offset"), F.count("*").alias("total"))
    return df.where(F.col(key) >= start).orderBy(key).limit(limit).crossJoin(F.broadcast(counts))


def keyset(df: DataFrame, at: str, key: str, limit: int = DEFAULT_LIMIT, cursor: tuple | None = None, legacy: bool = False) -> DataFrame:
    """The newest rows before a cursor, one more than ``limit`` if there are more.

    The cursor is (time, id) and rows compare as pairs; ``legacy`` compares times alone and so skips rows that share
    the boundary's time.
    """
    if limit < 1:
        raise ValueError("limit from 1")
    if cursor is not None:
        before = F.col(at) < F.lit(cursor[0])
        df = df.where(before if legacy else before | ((F.col(at) == F.lit(cursor[0])) & (F.col(key) < F.lit(cursor[1]))))
    return df.orderBy(F.desc(at), F.desc(key)).limit(limit + 1)


def keyset_page(df: DataFrame, at: str, key: str, limit: int = DEFAULT_LIMIT, cursor: tuple | None = None, legacy: bool = False) -> DataFrame:
    """At most ``limit`` rows with ``has_more`` and, where there is more, ``next_cursor`` and ``next_id``: the last row's
    time and key, which together are the next page's cursor."""
    got = keyset(df, at, key, limit, cursor, legacy)
    window = Window.orderBy(F.desc(at), F.desc(key))  # over limit + 1 rows
    every = Window.partitionBy()
    rows = got.withColumn("__place", F.row_number().over(window)).withColumn("has_more", F.count("*").over(every) > limit).where(F.col("__place") <= limit)
    last = F.min(F.struct(F.col(at).alias("at"), F.col(key).alias("key"))).over(every)
    rows = rows.withColumn("__last", F.when(F.col("has_more"), last))
    return rows.withColumn("next_cursor", F.col("__last.at")).withColumn("next_id", F.col("__last.key")).drop("__place", "__last")


def ilike_contains(c: Column, part: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` in the text act as wildcards, as they do in SQL."""
    return c.ilike(f"%{part}%")


def folded_contains(part: str, *columns: Column) -> Column:
    """Whether any column contains the text after folding case, diacritics and punctuation."""
    wanted = fold_for_search(F.lit(part))
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(fold_for_search(c).contains(wanted), F.lit(False))
    return found


def split_by_presence(asked: DataFrame, held: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What of ``asked`` is held, and what is missing."""
    return asked.join(held.select(key), key, "left_semi"), asked.join(held.select(key), key, "left_anti")


def resolved(lists: DataFrame, key: str, ids: str, sources: DataFrame, source_key: str) -> DataFrame:
    """Ids of each row's list with their sources, in order of the list; ids without a source are dropped."""
    asked = lists.select(key, F.posexplode(ids).alias("pos", source_key))
    return asked.join(sources, source_key)


def expanded(names: DataFrame, name: str, hierarchy: DataFrame) -> DataFrame:
    """Names with the leaves of their group (``parent, pos, leaf``); unknown names go, leaves of two groups come twice."""
    return names.join(dimension(hierarchy), names[name] == hierarchy["parent"])


def toggled(selected: Column, value: Column) -> Column:
    return F.when(F.array_contains(selected, value), F.array_except(selected, F.array(value))).otherwise(F.array_union(selected, F.array(value)))


def replaced_group(selected: Column, group: Column, chosen: Column) -> Column:
    """The selection without the group's members, and then the chosen ones."""
    return F.array_union(F.array_except(selected, group), chosen)


def selection_state(selected: Column, members: Column) -> Column:
    n = F.size(F.array_intersect(selected, members))
    return F.struct(n.alias("selected"), (n == F.size(members)).alias("every"), (n > 0).alias("some"))


def metadata_rows(books: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """``key, label, value`` for each named column that is not null or empty."""
    kept = books.select(key, *(F.col(c).cast("string").alias(label) for c, label in columns.items()))
    return kept.unpivot([key], list(columns.values()), "label", "value").where("value is not null and value <> ''")


def projected(df: DataFrame, heavy: list[str], wide: bool = False) -> DataFrame:
    """All columns, or all but the heavy ones, which are then not read."""
    return df if wide else df.drop(*heavy)


def by_locale(name: str, key: str) -> list[Column]:
    """An order of names as readers expect it (Unicode collation: case and accents come after letters); ties by key."""
    return [F.collate(F.col(name), "UNICODE").asc(), F.col(key).asc()]


def with_names_in(rows: DataFrame, key: str, named: DataFrame, named_key: str, name: str, wanted: list[str]) -> DataFrame:
    """Rows whose key belongs to one of the wanted names."""
    return rows.join(named.where(F.col(name).isin(wanted)).select(F.col(named_key).alias(key)), key, "left_semi")


def group_members(groups: DataFrame, entities: DataFrame, name: str, key: str) -> DataFrame:
    """``group, members``: keys of each group's names (``group, pos, member``) in declared order; groups without any go."""
    found = groups.join(entities.select(F.col(name).alias("member"), F.col(key).alias("__key")), "member")
    return found.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "__key"))), lambda x: x["__key"]).alias("members"))


def scroll(loaded: DataFrame, key: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Where scrolling goes on in both ways, from the stretches ``key, offset, n, total`` that are loaded.

    Up: an offset not below 0 and as many rows as are left before the first one. Down: the place after the last row.
    """
    edges = loaded.groupBy(key).agg(F.min("offset").alias("low"), F.max(F.col("offset") + F.col("n")).alias("next"), F.max("total").alias("total"))
    return edges.select(key, F.greatest(F.lit(0), F.col("low") - limit).alias("previous"), F.least(F.lit(limit), F.col("low")).alias("n_previous"), "next", (F.col("next") < F.col("total")).alias("more"))
