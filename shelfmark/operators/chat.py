"""Conversations: history windows, budgets, paging, citations of messages, and state changes as pure transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import citation_groups, cited_ids, history_content, stripped, text_between_citations
from shelfmark.operators import scans

#: Turns and characters that a request takes along.
USER_TURNS, MIXED_TURNS, TRIAGE_TURNS, MAX_CHARS, KEEP_AT_LEAST = 15, 6, 10, 200_000, 4
MAX_QUERY, MAX_TEXT, MAX_TEXTS = 2000, 8000, 10
#: Sources that one prompt takes, as many as a search gives at most.
MOST_BLOCKS = 100
DEFAULT_TITLE = "New Conversation"
STOPPED = "Generation stopped."


def usable(messages: DataFrame, content: str = "content", triage: str = "is_triage") -> DataFrame:
    """Messages with text that are not triage replies."""
    return messages.where((stripped(F.col(content)) != "") & ~F.coalesce(F.col(triage), F.lit(False)))


def last_n(messages: DataFrame, n: int, key: str, order: str, role: str | None = None, role_column: str = "role") -> DataFrame:
    """The newest n messages of each conversation (of one role, if given); of equal places, those with the greater rest."""
    rows = messages if role is None else messages.where(F.col(role_column) == role)
    window = Window.partitionBy(key).orderBy(F.desc(order), *(F.desc(c) for c in rows.columns if c not in (key, order)))
    return rows.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= n).drop("__n")


def budgeted(messages: DataFrame, key: str, order: str, size: Column, budget: int = MAX_CHARS, least: int = KEEP_AT_LEAST) -> DataFrame:
    """The newest messages that fit the budget; the oldest go in pairs, until ``least`` or fewer are left.

    The cut is the first even place from which on the rest fits, but no pair goes once the place is within ``least``
    of the end; an odd number of messages can so keep one less than ``least``.
    """
    sized = messages.withColumn("__size", size.cast("long"))
    placed = scans.running(scans.dealt(sized, order), [key], [order], sums={"__upto": F.coalesce("__size", F.lit(0).cast("long")), "__n": F.lit(1).cast("long")})
    all_of = sized.groupBy(F.col(key).alias("__key")).agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("__sum"), F.count("*").alias("__count"))
    placed = placed.join(all_of, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    place, rest = F.col("__n") - 1, F.col("__sum") - F.col("__upto") + F.coalesce("__size", F.lit(0))
    fits = (place % 2 == 0) & ((rest <= budget) | (place >= F.col("__count") - least))
    cuts = placed.groupBy(F.col(key).alias("__key")).agg(F.coalesce(F.min(F.when(fits, place)), F.lit(0)).alias("__cut"))
    kept = placed.join(cuts, F.col(key).eqNullSafe(F.col("__key"))).where(place >= F.col("__cut"))
    return kept.select(*messages.columns)


def chat_size(content: Column, sources: Column | None = None) -> Column:
    """Characters of a message and of its sources as JSON."""
    own = F.length(F.coalesce(content, F.lit("")))
    return own if sources is None else own + F.coalesce(F.length(F.to_json(sources)), F.lit(0))


def latest_with_more(messages: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """The newest n messages of each conversation in order of time, the number of all, and whether older ones exist."""
    if n < 1:
        raise ValueError("n from 1")
    newest = Window.partitionBy(key).orderBy(F.desc(at))
    rows = messages.withColumn("__n", F.row_number().over(newest)).withColumn("total", F.count("*").over(Window.partitionBy(key)))
    return rows.where(F.col("__n") <= n).withColumn("has_more", F.col("total") > n).drop("__n").orderBy(key, at)


def owned(conversations: DataFrame, conversation_id: str, user_id: str) -> DataFrame:
    """The conversation; an error if it is absent, and another one if it is someone else's."""
    found = conversations.where(F.col("id") == conversation_id).limit(1)
    row = found.select("user_id").first()
    if row is None:
        raise LookupError("no such conversation")
    if row["user_id"] != user_id:
        raise PermissionError("the conversation belongs to someone else")
    return found


def with_sources(messages: DataFrame, key: str, content: str, chunks: DataFrame, chunk_key: str = "id") -> DataFrame:
    """``key, sources``: each message's cited chunks in order of citation; unknown ids are dropped."""
    asked = messages.select(key, F.posexplode(cited_ids(F.col(content))).alias("pos", chunk_key))
    hit = asked.join(chunks, chunk_key)
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.struct(*[F.col(c) for c in chunks.columns]).alias("chunk"))))
    return hit.groupBy(key).agg(F.transform(ordered, lambda s: s["chunk"]).alias("sources"))


def segmented(messages: DataFrame, key: str, content: str, chunks: DataFrame, chunk_key: str = "id", keep_unresolved: bool = False) -> DataFrame:
    """``key, part, text, ids, sources``: each message in parts, numbered in order: texts (even) and runs of citations (odd).

    ``ids`` are all that a run cites, ``sources`` those of them that are known, in the same order. Empty texts are left
    out, and so are runs without a known source, unless ``keep_unresolved``.
    """
    split = messages.select(key, text_between_citations(F.col(content)).alias("text"), citation_groups(F.col(content)).alias("ids"))
    pieces = split.select(key, F.posexplode(F.arrays_zip("text", "ids")).alias("at", "piece")).select(key, "at", "piece.*")
    known = chunks.select(F.col(chunk_key).alias("__id"), F.struct(*chunks.columns).alias("chunk"))
    cited = pieces.select(key, "at", "ids", F.posexplode("ids").alias("pos", "__id")).join(known, "__id", "left")
    # collect_list leaves out what is null: ids without a chunk
    found = F.array_sort(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("pos", "chunk"))))
    runs = cited.groupBy(key, "at", "ids").agg(F.transform(found, lambda s: s["chunk"]).alias("sources"))
    if not keep_unresolved:
        runs = runs.where(F.size("sources") > 0)
    texts = pieces.where("text <> ''").select(key, (F.col("at") * 2).alias("part"), "text")
    return texts.unionByName(runs.select(key, (F.col("at") * 2 + 1).alias("part"), "ids", "sources"), allowMissingColumns=True)


def history_lines(messages: DataFrame, key: str, order: str, names: dict[str, str], most: int | None = None) -> DataFrame:
    """``key, history``: one line for each message, in order; of answers, only what stands before the mark."""
    content = history_content(F.col("role"), stripped(F.col("content")))
    if most is not None:
        content = F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("..."))).otherwise(content)
    name = F.coalesce(*(F.when(F.col("role") == r, F.lit(n)) for r, n in names.items()), F.lit(list(names.values())[-1]))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(name, F.lit(": "), content).alias("line"))))
    return messages.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))


def source_blocks(hits: DataFrame, key: str, order: str, template: str = "[%s] %s, %s\n%s", most: int = MOST_BLOCKS) -> DataFrame:
    """``key, piece, prompt``: one block for each source, in order, with blank lines between, ``most`` in each piece."""
    block = F.format_string(template, F.col("id").cast("string"), "book_name", "author", stripped(F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    placed = scans.pieces(hits, [key], [order], most)
    return placed.groupBy(key, "piece").agg(F.array_join(F.transform(parts, lambda p: p["b"]), "\n\n").alias("prompt"))


# --- state changes: each takes the tables and returns the new ones ---------------------------------------------------


def create_conversation(conversations: DataFrame, messages: DataFrame, row: dict, nested: list[dict] = ()) -> tuple[DataFrame, DataFrame]:
    """One more conversation (with a default title) and its first messages."""
    spark = conversations.sparkSession
    new = spark.createDataFrame([tuple({"title": DEFAULT_TITLE, **row}.get(c) for c in conversations.columns)], conversations.schema)
    return conversations.unionByName(new), append_rows(messages, [{**m, "conversation_id": row["id"]} for m in nested])


def append_rows(table: DataFrame, rows: list[dict]) -> DataFrame:
    return table.unionByName(table.sparkSession.createDataFrame([tuple(r.get(c) for c in table.columns) for r in rows], table.schema)) if rows else table


def touch(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations whose ``updated_at`` is the newest of their own and their messages' times."""
    newest = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_at").alias("__at"))
    return conversations.join(newest, "id", "left").withColumn("updated_at", F.greatest("updated_at", "__at")).select(*conversations.columns)


def set_title(conversations: DataFrame, conversation_id: str, title: str) -> DataFrame:
    return conversations.withColumn("title", F.when(F.col("id") == conversation_id, F.lit(title)).otherwise(F.col("title")))


def delete_conversations(conversations: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations in ``ids(id)``."""
    return conversations.join(ids, "id", "left_anti"), messages.join(ids.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_anti").select(*messages.columns)


def route(authenticated: Column, suggested_first: Column) -> Column:
    """Where an exchange is stored: conversations, anonymous, or nowhere."""
    return F.when(authenticated, "conversations").when(~suggested_first, "anonymous")


def prepended(chats: DataFrame, new: DataFrame, order: str = "pos") -> DataFrame:
    """The list with new rows before all others."""
    moved = chats.crossJoin(F.broadcast(new.agg(F.count("*").alias("__n")))).withColumn(order, F.col(order) + F.col("__n")).drop("__n")
    return new.unionByName(moved)


def patched(chats: DataFrame, key: str, value: object, changes: dict[str, Column]) -> DataFrame:
    """The row with this key changed; a change of the key itself renames it."""
    return chats.select(*(F.when(F.col(key) == F.lit(value), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in chats.columns))


def appended_page(chats: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """The list with the rows of one more page that it does not have yet."""
    return chats.unionByName(more.join(chats.select(key), key, "left_anti").select(*chats.columns))


def cited_only(messages: DataFrame, content: str, sources: DataFrame, key: str = "id") -> DataFrame:
    """The sources that some message cites."""
    return sources.join(messages.select(F.explode(cited_ids(F.col(content))).alias(key)).distinct(), key, "left_semi")


def merged_lists(results: DataFrame, key: str, order: str, values: str) -> DataFrame:
    """``key, values``: the lists of a request's few results, one after the other; repeats stay."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(values).alias("v"))))
    return results.groupBy(key).agg(F.flatten(F.transform(parts, lambda p: p["v"])).alias(values))


def over_budget(messages: DataFrame, key: str, size: Column, most: int = MAX_CHARS) -> DataFrame:
    """``key, blocked``: chats with so many characters take no further message."""
    return messages.groupBy(key).agg((F.sum(size) >= most).alias("blocked"))


def without_sources(requests: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Requests that no source answers."""
    return requests.join(hits.select(key), key, "left_anti")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last in order; of equal places, that with the greatest rest."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(order, *others)).alias("r")).select(key, "r.*")


# --- checks of requests ---------------------------------------------------------------------------------------------


def check_query(query: str) -> str:
    if not query.strip() or len(query) > MAX_QUERY:
        raise ValueError(f"a query has 1 to {MAX_QUERY} characters and is not blank")
    return query.strip()


def check_texts(texts: list[str]) -> list[str]:
    kept = [t.strip() for t in texts if t.strip()]
    if not kept or len(texts) > MAX_TEXTS or any(len(t) > MAX_TEXT for t in texts):
        raise ValueError(f"1 to {MAX_TEXTS} texts of at most {MAX_TEXT} characters, not all blank")
    return kept


def check_settings(top_k: int = 15, temperature: float = 0.0, max_tokens: int = 1) -> None:
    if not 1 <= top_k <= 100 or not 0 <= temperature <= 2 or not 1 <= max_tokens <= 65_536:
        raise ValueError("top_k 1 to 100, temperature 0 to 2, max_tokens 1 to 65536")


def check_role(role: str) -> str:
    if role not in ("user", "assistant"):
        raise ValueError("the role is user or assistant")
    return role


def goes_on(intent: Column, reply: Column) -> Column:
    """Whether a request is searched for: its intent is retrieve (or unknown), or there is no reply yet."""
    return (F.coalesce(intent, F.lit("retrieve")) == "retrieve") | (F.coalesce(stripped(reply), F.lit("")) == "")
