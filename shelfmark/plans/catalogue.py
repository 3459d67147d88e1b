"""Catalogue and page queries over the star tables: parts stand for books, nations and regions for authors and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators import catalog, pages
from shelfmark.plans.base import Queries
from shelfmark.session import table

query = Queries()

# Higher-order categories and their leaves; two leaves are under two parents.
HIERARCHY = {
    "العقيدة": ["العقيدة", "الفرق والردود", "كتب السنة", "الجوامع"],
    "التفسير": ["التفسير", "علوم القرآن وأصول التفسير"],
    "التجويد والقراءات": ["التجويد والقراءات"],
    "كتب الحديث و الشروح": ["كتب السنة", "شروح الحديث", "التخريج والأطراف"],
    "علوم الحديث والعلل": ["العلل والسؤلات الحديثية", "علوم الحديث"],
    "الفقة": [
        "أصول الفقه", "علوم الفقه والقواعد الفقهية", "الفقه الحنفي", "الفقه المالكي", "الفقه الشافعي", "الفقه الحنبلي", "الفقه العام", "مسائل فقهية",
        "السياسة الشرعية والقضاء", "الفرائض والوصايا", "الفتاوى", "الجوامع",
    ],
    "السيرة النبوية": ["السيرة النبوية"],
    "التاريخ": ["التاريخ"],
    "التراجم والطبقات": ["التراجم والطبقات"],
    "اللغة والأدب": ["الغريب والمعاجم", "النحو والصرف", "الأدب"],
}


def hierarchy(spark):
    return spark.createDataFrame([(p, i, leaf) for p, leaves in HIERARCHY.items() for i, leaf in enumerate(leaves)], "parent string, pos int, leaf string")


_HIERARCHY_SQL = ", ".join(f"('{p}', {i}, '{leaf}')" for p, leaves in HIERARCHY.items() for i, leaf in enumerate(leaves))
_STAR = "SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"


def _star(spark, sf):
    nations = table(spark, sf, "nation").where("n_nationkey < 20")
    return catalog.star(table(spark, sf, "customer"), (catalog.dimension(nations, 25), "c_nationkey", "n_nationkey"), (catalog.dimension(table(spark, sf, "region"), 5), "n_regionkey", "r_regionkey"))


@query("jn_1_left_joins", _STAR)
def _(spark, sf):
    return _star(spark, sf).select("c_custkey", "c_name", "n_name", "r_name")


@query("jn_2_point_join", f"{_STAR} WHERE c_custkey = 42")
def _(spark, sf):
    return _star(spark, sf).where("c_custkey = 42").select("c_custkey", "c_name", "n_name", "r_name")


@query("flt_6_in_filters", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (1, 5, 9) AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_nationkey").isin(1, 5, 9) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_name")


@query("flt_7_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%E_gi%'")
def _(spark, sf):
    return table(spark, sf, "part").where(catalog.ilike_contains(F.col("p_name"), "E_gi")).select("p_partkey", "p_name")


@query("flt_8_folded_search", "SELECT doc_id FROM documents WHERE contains(trim(regexp_replace(strip_accents(lower(trim(text))), '[-–—«»\"''`.,;:!?()\\[\\]{}/\\\\@#$%^&*_+=~|<>]', '', 'g')), 'ell')")
def _(spark, sf):
    return table(spark, sf, "documents").where(catalog.folded_contains("Éll", F.col("text"), F.col("source"))).select("doc_id")


@query("flt_10_option_filter", "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), lower('On_1')) AND trim(n_name) <> '-'")
def _(spark, sf):
    return table(spark, sf, "nation").where(F.lower("n_name").contains("on_1") & (F.trim("n_name") != "-")).select("n_nationkey", "n_name")


@query("top_2_page", "SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total, (SELECT ceil(count(*) / 20.0)::BIGINT FROM part) AS pages FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def _(spark, sf):
    return catalog.page_with_total(table(spark, sf, "part").select("p_partkey", "p_name"), [F.asc("p_name"), F.asc("p_partkey")], number=3)


@query("top_2_3_deep_page", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 20 OFFSET (SELECT count(*) * 9 // 10 FROM lineitem)")
def _(spark, sf):
    """A page nine tenths into all lines, by price."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return catalog.deep_page(lines, ["l_extendedprice", "l_orderkey", "l_linenumber"], lines.count() * 9 // 10)


@query("top_3_page_by_offset", "SELECT p_partkey, p_name FROM part WHERE p_size > 10 ORDER BY p_partkey LIMIT 15 OFFSET 7")
def _(spark, sf):
    return catalog.page(table(spark, sf, "part").where("p_size > 10").select("p_partkey", "p_name"), [F.asc("p_partkey")], number=9, limit=15, offset=7)


@query("top_4_seek", "SELECT page_id, url, (SELECT count(*) FROM pages WHERE page_id < 25) AS \"offset\", (SELECT count(*) FROM pages) AS total FROM pages WHERE page_id >= 25 ORDER BY page_id LIMIT 12")
def _(spark, sf):
    return catalog.seek(table(spark, sf, "pages").select("page_id", "url"), "page_id", 25, 12)


@query("top_12_names", "SELECT n_name, row_number() OVER (ORDER BY n_name) AS place FROM nation")
def _(spark, sf):
    from pyspark.sql import Window

    return table(spark, sf, "nation").select("n_name", F.row_number().over(Window.orderBy("n_name")).alias("place"))


def _keyset_sql(where: str) -> str:
    return f"""WITH got AS (SELECT o_orderkey, o_orderdate FROM orders WHERE {where} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21),
    placed AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, count(*) OVER () > 20 AS has_more FROM got)
    SELECT o_orderkey, o_orderdate, has_more, CASE WHEN has_more THEN (SELECT o_orderdate FROM placed WHERE place = 20) END AS next_cursor,
    CASE WHEN has_more THEN (SELECT o_orderkey FROM placed WHERE place = 20) END AS next_id FROM placed WHERE place <= 20"""


_AT = "1996-03-01 00:00:00"


@query("top_5_keyset_page", _keyset_sql(f"o_orderdate < TIMESTAMP '{_AT}' OR (o_orderdate = TIMESTAMP '{_AT}' AND o_orderkey < 700)"))
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return catalog.keyset_page(rows, "o_orderdate", "o_orderkey", 20, (F.to_timestamp(F.lit(_AT)), 700))


@query("top_5_keyset_page_legacy", _keyset_sql(f"o_orderdate < TIMESTAMP '{_AT}'"))
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return catalog.keyset_page(rows, "o_orderdate", "o_orderkey", 20, (F.to_timestamp(F.lit(_AT)), 700), legacy=True)


@query("jn_5_cache_split", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS held FROM documents")
def _(spark, sf):
    held, missing = catalog.split_by_presence(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")
    return held.withColumn("held", F.lit(True)).unionByName(missing.withColumn("held", F.lit(False)))


@query("jn_6_book_of_chunk", "SELECT l_orderkey, l_linenumber, (l_partkey * 10000000 + l_linenumber) // 10000000 AS book_id, coalesce(p_name, 'unknown') AS book_name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON p_partkey = (l_partkey * 10000000 + l_linenumber) // 10000000")
def _(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.book_of(F.col("l_partkey") * 10_000_000 + F.col("l_linenumber")).alias("book_id"))
    parts = table(spark, sf, "part").where("p_size < 25")
    return lines.join(parts, lines["book_id"] == parts["p_partkey"], "left").select("l_orderkey", "l_linenumber", "book_id", F.coalesce("p_name", F.lit("unknown")).alias("book_name"))


#: What books of the ``part`` table are filed under, by their key; the last is no category of the hierarchy.
_FILED = ["العقيدة", "كتب الحديث و الشروح", "الفقة", "nothing"]


@query("jn_7_category_expansion", f"SELECT p_partkey, name, pos, leaf FROM (SELECT p_partkey, {_FILED}[p_partkey % 4 + 1] AS name FROM part) JOIN (VALUES {_HIERARCHY_SQL}) h(parent, pos, leaf) ON name = parent")
def _(spark, sf):
    """The leaves under each book's category."""
    filed = F.element_at(F.array(*(F.lit(n) for n in _FILED)), (F.col("p_partkey") % 4 + 1).cast("int"))
    books = table(spark, sf, "part").select("p_partkey", filed.alias("name"))
    return catalog.expanded(books, "name", hierarchy(spark)).select("p_partkey", "name", "pos", "leaf")


@query("jn_9_group_overlap", "SELECT c_custkey FROM customer WHERE list_has_any([c_mktsegment, 'x'], ['BUILDING', 'FURNITURE'])")
def _(spark, sf):
    members = F.array(F.lit("BUILDING"), F.lit("FURNITURE"))
    return table(spark, sf, "customer").where(F.arrays_overlap(F.array("c_mktsegment", F.lit("x")), members)).select("c_custkey")


@query(
    "jn_10_toc_as_of",
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS placed FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
    heads AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, placed ORDER BY event_id) = 1)
    SELECT p.user_id, p.event_id, epoch_us(p.ts) // 1000 AS active, heads.event_id AS entry FROM events p ASOF LEFT JOIN heads ON p.user_id = heads.user_id AND epoch_us(p.ts) // 1000 >= heads.placed""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    kind = events.agg(F.min("event_type").alias("kind"))
    entries = events.join(F.broadcast(kind), events["event_type"] == kind["kind"]).select("user_id", F.col("event_id").alias("id"), F.col("at").alias("page_id"), F.col("event_id").alias("pos"))
    return pages.as_of(events.withColumnRenamed("at", "active"), entries, "event_id", "active", by="user_id")


_TOC = "SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 99999999 ELSE p_partkey // 4 END AS parent FROM part"


def _toc(spark, sf):
    parent = F.when(F.col("p_partkey") % 11 == 0, 99_999_999).otherwise(F.expr("p_partkey div 4"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), parent.alias("parent"))


@query("jn_11_toc_tree", f"WITH toc AS ({_TOC}) SELECT a.id, b.id IS NULL OR a.parent = 0 AS root, CASE WHEN b.id IS NOT NULL AND a.parent <> 0 THEN a.parent END AS parent_id FROM toc a LEFT JOIN toc b ON a.parent = b.id")
def _(spark, sf):
    return pages.tree(_toc(spark, sf)).select("id", "root", "parent_id")


@query(
    "jn_11_toc_depth",
    f"""WITH RECURSIVE toc AS ({_TOC}), linked AS (SELECT a.id, CASE WHEN b.id IS NOT NULL AND a.parent <> 0 THEN a.parent END AS parent FROM toc a LEFT JOIN toc b ON a.parent = b.id),
    walk AS (SELECT id, 0 AS depth, id::VARCHAR AS path FROM linked WHERE parent IS NULL UNION ALL SELECT l.id, depth + 1, path || '/' || l.id FROM walk w JOIN linked l ON l.parent = w.id)
    SELECT id, depth, path FROM walk""",
)
def _(spark, sf):
    return pages.depths(_toc(spark, sf))


@query(
    "win_3_islands",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS r FROM lineitem),
    c AS (SELECT *, CASE WHEN r > 1 AND l_returnflag IS NOT DISTINCT FROM lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY r) THEN 0 ELSE 1 END AS changed FROM r),
    n AS (SELECT *, sum(changed) OVER (PARTITION BY l_orderkey ORDER BY r ROWS UNBOUNDED PRECEDING) - 1 AS island FROM c)
    SELECT l_orderkey, island::BIGINT AS island, min(l_returnflag) AS flag, min(l_linenumber) AS first_line, count(*) AS n FROM n GROUP BY 1, 2""",
)
def _(spark, sf):
    runs = pages.islands(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey", "l_linenumber", "l_returnflag")
    return runs.groupBy("l_orderkey", "island").agg(F.min("l_returnflag").alias("flag"), F.min("l_linenumber").alias("first_line"), F.count("*").alias("n"))


@query(
    "win_3_4_page_groups",
    r"""WITH p AS (SELECT o_custkey AS book_id, o_orderkey AS page_id, o_orderstatus AS page_num, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS part_title,
        '<div>' || o_orderkey || '</div> ' AS display_elem FROM orders),
    c AS (SELECT *, CASE WHEN page_num IS NOT DISTINCT FROM lag(page_num) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS changed FROM p WINDOW w AS (PARTITION BY book_id ORDER BY page_id)),
    n AS (SELECT *, (sum(changed) OVER (PARTITION BY book_id ORDER BY page_id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS island FROM c),
    m AS (SELECT *, row_number() OVER (PARTITION BY book_id, island ORDER BY page_id DESC) = 1 AS last FROM n),
    g AS (SELECT book_id, island, min(page_num) AS page_num, min(page_id) AS first_page, count(*) AS n_pages, arg_max(part_title, page_id) FILTER (part_title <> '') AS part_title,
        string_agg(CASE WHEN last THEN display_elem ELSE regexp_replace(display_elem, '</div>\s*$', '</div><br><br>') END, '' ORDER BY page_id) AS html FROM m GROUP BY 1, 2)
    SELECT *, coalesce(part_title, '') <> '' AND part_title IS DISTINCT FROM lag(part_title) OVER (PARTITION BY book_id ORDER BY island) AS show_title FROM g""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("page_id"), F.col("o_orderstatus").alias("page_num"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("part_title"), F.concat(F.lit("<div>"), "o_orderkey", F.lit("</div> ")).alias("display_elem"),
    )
    return pages.page_groups(rows)


@query(
    "prj_6_metadata_rows",
    """SELECT s_suppkey, label, value FROM (SELECT s_suppkey, 'Name' AS label, s_name AS value FROM supplier UNION ALL
    SELECT s_suppkey, 'Nation', CASE WHEN s_nationkey < 5 THEN '' ELSE s_nationkey::VARCHAR END FROM supplier UNION ALL
    SELECT s_suppkey, 'Volumes', nullif(regexp_extract(s_suppkey || ' vols', '^(\\d+)', 1), '') FROM supplier) WHERE value IS NOT NULL AND value <> ''""".replace("\\\\", "\\"),
)
def _(spark, sf):
    rows = table(spark, sf, "supplier").select(
        "s_suppkey", "s_name", F.when(F.col("s_nationkey") < 5, "").otherwise(F.col("s_nationkey").cast("string")).alias("nation"), text.leading_digits(F.concat("s_suppkey", F.lit(" vols"))).alias("volumes")
    )
    return catalog.metadata_rows(rows, "s_suppkey", {"s_name": "Name", "nation": "Nation", "volumes": "Volumes"})


@query("set_5_missing_ids", "SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def _(spark, sf):
    held = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_custkey").distinct().join(held, "o_custkey", "left_anti")


@query(
    "set_6_agg_13_selection",
    """SELECT c_custkey, list_sort(CASE WHEN c_nationkey % 2 = 0 THEN [x for x in [0, 2, 4, 6] if x <> c_nationkey % 8] ELSE [0, 2, 4, 6, c_nationkey % 8] END)::VARCHAR AS toggled,
    len([x for x in [0, 2, 4, 6] if x IN (2, 3, c_nationkey % 8)]) AS selected FROM customer""",
)
def _(spark, sf):
    chosen, value = F.array(*(F.lit(i) for i in (0, 2, 4, 6))), F.col("c_nationkey") % 8
    state = catalog.selection_state(chosen, F.array_distinct(F.array(F.lit(2), F.lit(3), value)))
    shown = F.concat(F.lit("["), F.array_join(F.array_sort(catalog.toggled(chosen, value)).cast("array<string>"), ", "), F.lit("]"))
    return table(spark, sf, "customer").select("c_custkey", shown.alias("toggled"), state["selected"].cast("bigint").alias("selected"))


@query("udf_6_chunks")
def _(spark, sf):
    return pages.chunks(table(spark, sf, "documents").select("doc_id", "text"))
