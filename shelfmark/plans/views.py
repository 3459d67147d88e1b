"""Views of lists, groups and single pages, and checks on requests, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators import catalog, chat, pages
from shelfmark.plans.base import Queries
from shelfmark.session import table

query = Queries()


@query("prj_3_wide_and_narrow", "SELECT doc_id, lang, source, n_chars, NULL::VARCHAR AS digest FROM documents UNION ALL SELECT doc_id, lang, source, n_chars, md5(text) FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    narrow = catalog.projected(docs, ["text"]).withColumn("digest", F.lit(None).cast("string"))
    wide = catalog.projected(docs, ["text"], wide=True).withColumn("digest", F.md5("text")).drop("text")
    return narrow.unionByName(wide)


@query("prj_4_one_column_by_key", "SELECT page_id, html FROM pages WHERE page_id = 7")
def _(spark, sf):
    return table(spark, sf, "pages").where("page_id = 7").select("page_id", "html")


@query("prj_5_summaries", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


@query("top_11_locale_page", "SELECT p_partkey, name FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part) ORDER BY lower(name), name DESC, p_partkey LIMIT 100")
def _(spark, sf):
    names = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    return catalog.page(names, catalog.by_locale("name", "p_partkey"), limit=100)


@query("flt_9_jn_9_ids_of_names", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name IN ('NATION_3', 'NATION_7', 'none'))")
def _(spark, sf):
    return catalog.with_names_in(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", table(spark, sf, "nation"), "n_nationkey", "n_name", ["NATION_3", "NATION_7", "none"])


_GROUPS = [("a", 0, "NATION_9"), ("a", 1, "none"), ("a", 2, "NATION_2"), ("b", 0, "none"), ("c", 0, "NATION_4")]


@query(
    "jn_8_group_members",
    f"""SELECT g AS "group", string_agg(n_nationkey::VARCHAR, ',' ORDER BY pos) AS members FROM (VALUES {', '.join(map(str, _GROUPS))}) v(g, pos, member) JOIN nation ON n_name = member GROUP BY 1""",
)
def _(spark, sf):
    groups = spark.createDataFrame(_GROUPS, "group string, pos int, member string")
    found = catalog.group_members(groups, table(spark, sf, "nation"), "n_name", "n_nationkey")
    return found.select("group", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(
    "jn_3_6_book_and_author",
    """SELECT l_orderkey, l_linenumber, coalesce(p_name, 'unknown') AS book, coalesce(s_name, 'unknown') AS author
    FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON p_partkey = (l_partkey * 10000000 + l_linenumber) // 10000000
    LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey <> 3) ON s_suppkey::VARCHAR = (p_partkey % 50)::VARCHAR""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.book_of(F.col("l_partkey") * 10_000_000 + F.col("l_linenumber")).alias("book_id"))
    books = table(spark, sf, "part").where("p_size < 25").select("p_partkey", "p_name", (F.col("p_partkey") % 50).cast("string").alias("author_id"))
    authors = table(spark, sf, "supplier").where("s_nationkey <> 3").select(F.col("s_suppkey").cast("string").alias("s_key"), "s_name")
    joined = catalog.star(lines, (books, "book_id", "p_partkey"), (authors, "author_id", "s_key"))
    return joined.select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.lit("unknown")).alias("book"), F.coalesce("s_name", F.lit("unknown")).alias("author"))


@query(
    "jn_10_clicked_entry",
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 86400000000 AS placed FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
    heads AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, placed ORDER BY event_id) = 1)
    SELECT p.user_id, p.event_id, epoch_us(p.ts) // 86400000000 AS active, coalesce(own.event_id, heads.event_id) AS entry
    FROM events p ASOF LEFT JOIN heads ON p.user_id = heads.user_id AND epoch_us(p.ts) // 86400000000 >= heads.placed LEFT JOIN e own ON own.event_id = p.event_id""",
)
def _(spark, sf):
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("long")
    events = table(spark, sf, "events").select("user_id", "event_id", day.alias("active"), "event_type")
    kind = events.agg(F.min("event_type").alias("kind"))
    entries = events.join(F.broadcast(kind), events["event_type"] == kind["kind"]).select("user_id", F.col("event_id").alias("id"), F.col("active").alias("page_id"), F.col("event_id").alias("pos"))
    return pages.as_of_clicked(events.withColumn("clicked", F.col("event_id")), entries, "event_id", "active", "clicked", by="user_id").select("user_id", "event_id", "active", "entry")


@query(
    "win_8_scroll",
    """SELECT o_custkey, greatest(0, min(place) - 20) AS previous, least(20, min(place)) AS n_previous, max(place + 5) AS next, max(place + 5) < 1200 AS more
    FROM (SELECT o_custkey, o_orderkey % 1000 AS place FROM orders) GROUP BY 1""",
)
def _(spark, sf):
    loaded = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 1000).alias("offset"), F.lit(5).alias("n"), F.lit(1200).alias("total"))
    return catalog.scroll(loaded, "o_custkey", 20)


@query("flt_18_cited_only", r"SELECT doc_id AS id, source FROM documents WHERE doc_id IN (SELECT unnest(regexp_extract_all('see [' || (doc_id * 2) || ', ' || (doc_id * 3) || ']', '\d+'))::BIGINT FROM documents)")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    messages = docs.select(F.concat(F.lit("see ["), F.col("doc_id") * 2, F.lit(", "), F.col("doc_id") * 3, F.lit("]")).alias("content"))
    return chat.cited_only(messages, "content", docs.select(F.col("doc_id").alias("id"), "source"))


@query(
    "fn_28_sparse_shapes",
    """WITH p AS (SELECT vec_id, [i - 1 for i in range(1, 65) if embedding[i] > 0] AS ids, [x::DOUBLE for x in embedding if x > 0] AS vals FROM embeddings)
    SELECT vec_id, array_to_string(ids, ',') AS indices, round(list_sum(vals), 6) AS total, len(vals) AS n, round(list_dot_product(vals, [(i + 1)::DOUBLE for i in ids]), 6) AS placed FROM p""",
)
def _(spark, sf):
    entries = F.filter(F.transform("embedding", lambda x, i: F.struct(i.cast("bigint").alias("key"), x.cast("double").alias("value"))), lambda e: e["value"] > 0)
    rows = table(spark, sf, "embeddings").select("vec_id", F.map_from_entries(entries).alias("m"))
    m, total = F.col("m"), lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    placed = F.zip_with(text.dense(m, 64), F.sequence(F.lit(1), F.lit(64)), lambda v, i: v * i)
    return rows.select(
        "vec_id", F.array_join(text.sparse_indices(m).cast("array<string>"), ",").alias("indices"), F.round(total(text.sparse_values(m)), 6).alias("total"),
        F.size(text.sparse_items(m)).cast("bigint").alias("n"), F.round(total(placed), 6).alias("placed"),
    )


@query("fn_29_sparse_json", "SELECT doc_id, doc_id AS key, 0.5::DOUBLE AS value FROM documents UNION ALL SELECT doc_id, 90000000, 2.0 FROM documents")
def _(spark, sf):
    made = F.concat(F.lit('{"'), "doc_id", F.lit('": 0.5, "90000000": 2, "x": 1}'))
    return table(spark, sf, "documents").select("doc_id", F.explode(text.sparse_json(made)).alias("key", "value"))


@query("set_2_merged_results", "SELECT conv_id, sum(len(string_split(text, ' ')))::BIGINT AS n, string_agg(string_split(text, ' ')[1], ' ' ORDER BY turn) AS first FROM conversations GROUP BY 1")
def _(spark, sf):
    lists = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("words"))
    firsts = chat.merged_lists(lists.withColumn("words", F.slice("words", 1, 1)), "conv_id", "turn", "words").select("conv_id", F.array_join("words", " ").alias("first"))
    return chat.merged_lists(lists, "conv_id", "turn", "words").select("conv_id", F.size("words").cast("bigint").alias("n")).join(firsts, "conv_id")


@query(
    "dml_6_list_changes",
    """WITH l AS (SELECT DISTINCT conv_id, conv_id AS pos FROM conversations), m AS (SELECT -1 AS conv_id, 0 AS pos, 'new' AS title UNION ALL SELECT conv_id, pos + 1, 'chat ' || conv_id FROM l)
    SELECT CASE WHEN conv_id = 5 THEN 100000005 ELSE conv_id END AS conv_id, pos, CASE WHEN conv_id = 3 THEN 'Renamed' ELSE title END AS title FROM m
    UNION ALL SELECT conv_id + 200000000, 0, 'older' FROM l""",
)
def _(spark, sf):
    heads = table(spark, sf, "conversations").select("conv_id").distinct()
    chats = heads.select("conv_id", F.col("conv_id").alias("pos"), F.concat(F.lit("chat "), "conv_id").alias("title"))
    chats = chat.prepended(chats, spark.createDataFrame([(-1, 0, "new")], "conv_id long, pos long, title string"))
    chats = chat.patched(chat.patched(chats, "conv_id", 3, {"title": F.lit("Renamed")}), "conv_id", 5, {"conv_id": F.lit(100_000_005).cast("long")})
    page = heads.select((F.col("conv_id") + 200_000_000).alias("conv_id"), F.lit(0).cast("long").alias("pos"), F.lit("older").alias("title"))
    return chat.appended_page(chats, page.unionByName(page.withColumn("conv_id", F.lit(-1).cast("long")).limit(1)), "conv_id")


@query("ctl_8_blocked_chats", "SELECT conv_id, sum(length(text)) >= 4000 AS blocked FROM conversations GROUP BY 1")
def _(spark, sf):
    return chat.over_budget(table(spark, sf, "conversations"), "conv_id", chat.chat_size(F.col("text")), 4000)


@query("ctl_9_without_sources", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    return chat.without_sources(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").where("quality = 1"), "doc_id")
