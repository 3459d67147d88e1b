"""Queries on conversations, text functions, JSON and replies. Arabic text and citations are made up on both sides."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.functions import arabic, text
from shelfmark.operators import catalog, chat
from shelfmark.plans.base import Queries
from shelfmark.session import new_folder, table
from shelfmark.sources import files
from shelfmark.sources.stored_rows import StoredRows
from shelfmark.streaming import replies, sink

query = Queries()


def _strip(c: str) -> str:
    """SQL that takes all white space from both ends."""
    space = r"[\s\x0B\p{Z}\x{FEFF}]+"
    return f"regexp_replace({c}, '^{space}|{space}$', '', 'g')"


SENTENCES = ["ما حكم الصلاة في السفر؟", "إِنَّمَا الأعمالُ  بالنيات", "التي كتـــاب والكتاب", "المسلمون وبالحق كتابها", "قال وول hello world", "آداب مؤمن قارئ هدى فاطمة", "وكالفتح للمؤمنين فالكتاب", "أحاديث النبي ﷺ وسننه"]
_SENTENCE_SQL = "[" + ", ".join(f"'{s}'" for s in SENTENCES) + "]"


def _sentences(spark, sf, *more: str):
    return table(spark, sf, "documents").select("doc_id", *more, F.element_at(F.array(*(F.lit(s) for s in SENTENCES)), (F.col("doc_id") % len(SENTENCES) + 1).cast("int")).alias("s"))


_MADE = f"made AS (SELECT doc_id, {_SENTENCE_SQL}[doc_id % {len(SENTENCES)} + 1] AS s FROM documents)"


def _normal(c: str) -> str:
    return rf"trim(regexp_replace(translate(regexp_replace({c}, '{arabic.CORPUS_MARKS}', '', 'g'), '{arabic.LETTERS}', '{arabic.UNIFIED}'), '\s+', ' ', 'g'))"


def _stemmed(c: str) -> str:
    pre, post = arabic._longest_first(arabic.PREFIXES), arabic._longest_first(arabic.SUFFIXES)
    bare = rf"regexp_replace(regexp_replace({c}, '^(?:{pre})(.{{3,}})$', '\1'), '^(.{{3,}}?)(?:{post})$', '\1')"
    halved = f"CASE WHEN starts_with({bare}, 'وو') THEN substr({bare}, 2) ELSE {bare} END"
    return f"CASE WHEN length({c}) >= 3 AND length({halved}) >= 3 THEN {halved} ELSE {c} END"


@query("fn_1_arabic_normalize", f"WITH {_MADE} SELECT doc_id, {_normal('s')} AS normal FROM made")
def _(spark, sf):
    return _sentences(spark, sf).select("doc_id", arabic.normalize(F.col("s")).alias("normal"))


_FOLDED = f"translate(regexp_replace(chr(10) || s || chr(9), '{arabic.SEARCH_MARKS}', '', 'g'), '{arabic.LETTERS}', '{arabic.UNIFIED}')"


@query("fn_2_client_normalize", f"WITH {_MADE} SELECT doc_id, lower({_strip(_FOLDED)}) AS normal FROM made")
def _(spark, sf):
    return _sentences(spark, sf).select("doc_id", arabic.normalize_for_search(F.concat(F.lit("\n"), "s", F.lit("\t"))).alias("normal"))


_WORDS = rf"words AS (SELECT doc_id, unnest(list_filter([regexp_replace(x, '{arabic.NOT_ARABIC}', '', 'g') for x in string_split({_normal('s')}, ' ')], lambda x: length(x) >= 2)) AS w FROM made)"


@query("fn_5_light_stem", f"WITH {_MADE}, {_WORDS} SELECT doc_id, w, {_stemmed('w')} AS stem FROM words")
def _(spark, sf):
    words = _sentences(spark, sf).select("doc_id", F.explode(arabic.arabic_tokens(F.col("s"), stemmed=False, stops=())).alias("w"))
    return words.select("doc_id", "w", arabic.stem(F.col("w")).alias("stem"))


@query("fn_4_6_arabic_tokens", f"WITH {_MADE}, {_WORDS}, stems AS (SELECT doc_id, {_stemmed('w')} AS token FROM words) SELECT doc_id, token FROM stems WHERE token NOT IN ({', '.join(repr(s) for s in arabic.stop_words())})")
def _(spark, sf):
    return _sentences(spark, sf).select("doc_id", F.explode(arabic.arabic_tokens(F.col("s"))).alias("token"))


#: Words of several scripts whose letters carry marks.
SCRIPTS = "Йод ё Њива Ѓорѓи Άλφα ᾳ ΰ ǖ Ṩṩ Ệ ŭ"


@query("fn_3_search_fold", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(trim(text))), '[-–—«»"''`.,;:!?()\[\]{}/\\@#$%^&*_+=~|<>]', '', 'g'), '\s+', ' ', 'g')) AS folded FROM documents""".replace("lower(trim(text))", f"lower(text || ' {SCRIPTS}')"))
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", arabic.fold_for_search(F.concat("text", F.lit(f" {SCRIPTS}"))).alias("folded"))


def _cited(spark, sf):
    made = F.concat(F.lit("x ["), "doc_id", F.lit(", "), F.col("doc_id") + 1, F.lit("] y ["), F.col("doc_id") + 2, F.lit("،"), F.col("doc_id"), F.lit("] ["), F.col("doc_id") % 3, F.lit("] z [12,"))
    return table(spark, sf, "documents").select("doc_id", made.alias("t"))


_CITED = "cited AS (SELECT doc_id, 'x [' || doc_id || ', ' || (doc_id + 1) || '] y [' || (doc_id + 2) || '،' || doc_id || '] [' || (doc_id % 3) || '] z [12,' AS t FROM documents)"


@query(
    "fn_9_agg_10_citations",
    rf"""WITH {_CITED}, lists AS (SELECT doc_id, unnest(regexp_extract_all(t, '\[(\d+(?:\s*[,،]\s*\d+)*)\]', 1)) AS ids FROM cited)
    SELECT DISTINCT doc_id, unnest(string_split_regex(ids, '\s*[,،]\s*'))::BIGINT AS id FROM lists""",
)
def _(spark, sf):
    return _cited(spark, sf).select("doc_id", F.explode(text.cited_ids(F.col("t"))).alias("id"))


_RUN = r"\[\d+(?:\s*[,،]\s*\d+)*\](?:[\s,،]*\[\d+(?:\s*[,،]\s*\d+)*\])*"


@query(
    "win_7_citation_groups",
    rf"""WITH {_CITED} SELECT doc_id, len(regexp_extract_all(t, '{_RUN}')) AS n_groups, len(string_split_regex(t, '{_RUN}')) AS n_parts,
    array_to_string(list_transform(regexp_extract_all(t, '{_RUN}'), lambda r: array_to_string(regexp_extract_all(r, '\d+'), ',')), ' ') AS ids,
    regexp_replace(t, '\[\d+(?:\s*[,،]\s*\d*)*$', '') AS shown FROM cited""",
)
def _(spark, sf):
    t = F.col("t")
    return _cited(spark, sf).select(
        "doc_id", F.size(text.citation_groups(t)).cast("bigint").alias("n_groups"), F.size(text.text_between_citations(t)).cast("bigint").alias("n_parts"),
        F.array_join(F.transform(text.citation_groups(t), lambda g: F.array_join(g.cast("array<string>"), ",")), " ").alias("ids"), text.without_open_citation(t).alias("shown")
    )


def _segments(having: str) -> str:
    """Parts of the cited texts; the known sources are the English documents."""
    return rf"""WITH {_CITED}, split AS (SELECT doc_id, regexp_extract_all(t, '{_RUN}') AS runs, string_split_regex(t, '{_RUN}') AS texts FROM cited),
    text_parts AS (SELECT doc_id, unnest(range(len(texts))) * 2 AS part, unnest(texts) AS text FROM split),
    run_parts AS (SELECT doc_id, unnest(range(len(runs))) * 2 + 1 AS part, unnest(runs) AS run FROM split),
    asked AS (SELECT doc_id, part, unnest(range(len(regexp_extract_all(run, '\d+')))) AS pos, unnest(regexp_extract_all(run, '\d+'))::BIGINT AS id FROM run_parts),
    both_parts AS (SELECT doc_id, part, text, NULL AS ids, NULL AS sources FROM text_parts WHERE text <> '')
    SELECT * FROM both_parts
    UNION ALL
    SELECT f.doc_id, part, NULL, string_agg(f.id::VARCHAR, ',' ORDER BY pos), coalesce(string_agg(d.doc_id::VARCHAR, ',' ORDER BY pos), '')
    FROM asked f LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON d.doc_id = f.id GROUP BY 1, 2 {having}"""


def _segmented(spark, sf, keep_unresolved: bool):
    chunks = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), "source")
    parts = chat.segmented(_cited(spark, sf), "doc_id", "t", chunks, keep_unresolved=keep_unresolved)
    joined = F.array_join(F.transform("sources", lambda s: s["id"].cast("string")), ",")
    return parts.select("doc_id", F.col("part").cast("bigint").alias("part"), "text", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), joined.alias("sources"))


@query("fn_11_segments", _segments("HAVING count(d.doc_id) > 0"))
def _(spark, sf):
    return _segmented(spark, sf, False)


@query("fn_11_segments_unresolved_kept", _segments(""))
def _(spark, sf):
    return _segmented(spark, sf, True)


@query(
    "jn_4_citation_sources",
    f"""WITH {_CITED}, asked AS (SELECT doc_id, unnest([doc_id, doc_id + 1, doc_id + 2, doc_id % 3]) AS id, unnest([0, 1, 2, 3]) AS pos FROM cited),
    firsts AS (SELECT doc_id, id, min(pos) AS pos FROM asked GROUP BY 1, 2)
    SELECT f.doc_id, string_agg(d.source, ',' ORDER BY f.pos) AS sources FROM firsts f JOIN documents d ON d.doc_id = f.id GROUP BY 1""",
)
def _(spark, sf):
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    found = chat.with_sources(_cited(spark, sf), "doc_id", "t", chunks)
    return found.select("doc_id", F.array_join(F.transform("sources", lambda s: s["source"]), ",").alias("sources"))


#: Answers of one part; of two, whose parts are whole texts between line breaks; and of two empty ones.
_ANSWER = """CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN chr(10) || text || chr(10) || chr(10) || '<!-- DETAILED_ANSWER -->' || chr(13) || chr(10) || chr(9) || text || chr(160) || doc_id || chr(10)
    ELSE chr(10) || '<!-- DETAILED_ANSWER -->' || chr(10) END"""


@query("fn_12_split_answer", f"""WITH a AS (SELECT doc_id, {_ANSWER} AS t FROM documents) SELECT doc_id,
    CASE WHEN contains(t, '<!--') THEN nullif({_strip("split_part(t, '<!-- DETAILED_ANSWER -->', 1)")}, '') ELSE t END AS simple,
    CASE WHEN contains(t, '<!--') THEN nullif({_strip("split_part(t, '<!-- DETAILED_ANSWER -->', 2)")}, '') END AS detailed FROM a""")
def _(spark, sf):
    mark = F.lit(text.DETAIL_MARK)
    t = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\n"), "text", F.lit("\n\n"), mark, F.lit("\r\n\t"), "text", F.lit("\u00a0"), "doc_id", F.lit("\n")))
    t = t.otherwise(F.concat(F.lit("\n"), mark, F.lit("\n")))
    return table(spark, sf, "documents").select("doc_id", text.simple_answer(t).alias("simple"), text.detailed_answer(t).alias("detailed"))


@query("fn_14_html_clean", r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    html || '<font size="1" color="#be0000" x>12-٣</font>a[1, 2].b⦗٤⦘<p>  </p> <p class="c"></p>end', '<font[^>]*color="#be0000"[^>]*>[\d٠-٩\s\-]+</font>', '', 'g'), '\[[\d٠-٩،,\-\s]+\][.،,؛:]?', '', 'g'),
    '⦗[\d٠-٩\s\-]+⦘', '', 'g'), '(?:<p[^>]*>\s*</p>\s*)+', '<br><br>', 'g')) AS digest FROM pages""")
def _(spark, sf):
    added = '<font size="1" color="#be0000" x>12-٣</font>a[1, 2].b⦗٤⦘<p>  </p> <p class="c"></p>end'
    return table(spark, sf, "pages").select("page_id", F.md5(text.clean_html(F.concat("html", F.lit(added)))).alias("digest"))


def _letters(c: str, ranges: str) -> str:
    return f"length(regexp_replace({c}, '[^{ranges}]', '', 'g'))"


_RTL = r"\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
_LTR = r"A-Za-z\x{00C0}-\x{024F}\x{0370}-\x{03FF}\x{0400}-\x{04FF}"


@query(
    "fn_16_17_direction",
    f"""WITH {_MADE}, mixed AS (SELECT m.doc_id, repeat(s || ' ', m.doc_id % 40) || text AS s FROM made m JOIN documents d ON m.doc_id = d.doc_id)
    SELECT doc_id, CASE WHEN {_letters('substr(s, 1, 200)', _RTL)} > {_letters('substr(s, 1, 200)', 'A-Za-z')} THEN 'rtl' ELSE 'ltr' END AS head,
    CASE WHEN {_letters('s', _RTL)} > {_letters('s', _LTR)} THEN 'rtl' ELSE 'ltr' END AS whole FROM mixed""",
)
def _(spark, sf):
    """Whole texts, after none to 39 Arabic sentences."""
    s = F.concat(F.repeat(F.concat("s", F.lit(" ")), (F.col("doc_id") % 40).cast("int")), "text")
    return _sentences(spark, sf, "text").select("doc_id", text.direction(s).alias("head"), text.direction_of_all(s).alias("whole"))


@query("fn_18_shorten", "SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE substr(text, 1, 59) || '…' END AS shorter, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END AS cut FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.shortened(F.col("text"), 60).alias("shorter"), text.cut_with_dots(F.col("text"), 400).alias("cut"))


@query(
    "fn_19_20_times",
    """WITH d AS (SELECT event_id, ts, floor((epoch_us((SELECT max(ts) FROM events)) // 1000 - epoch_us(ts) // 1000) / 86400000.0)::BIGINT AS days FROM events)
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, epoch_us(ts) // 1000 AS ms,
    CASE WHEN days = 0 THEN strftime(ts, '%I:%M %p') WHEN days = 1 THEN 'Yesterday' WHEN days < 7 THEN days || ' days ago' ELSE strftime(ts, '%b %-d') END AS label FROM d""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    now = events.agg(F.max("ts").alias("now"))
    return events.crossJoin(F.broadcast(now)).select("event_id", text.iso_time(F.col("ts")).alias("iso"), text.millis(F.col("ts")).alias("ms"), text.relative_time(F.col("ts"), F.col("now")).alias("label"))


@query("fn_21_22_parameters", """WITH made AS (SELECT doc_id, chr(10) || (doc_id + 1) || ', x, -3, 0,' || chr(9) || '7' || chr(10) || ',' AS t, CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'no' END AS f FROM documents)
    SELECT doc_id, list_filter(list_transform(string_split(t, ','), lambda p: try_cast(trim(p, ' ' || chr(10) || chr(9)) AS BIGINT)), lambda v: v > 0)::VARCHAR AS ids, f = 'true' AS flag FROM made""")
def _(spark, sf):
    made = F.concat(F.lit("\n"), F.col("doc_id") + 1, F.lit(", x, -3, 0,\t7\n,"))
    ids = F.concat(F.lit("["), F.array_join(text.positive_ints(made).cast("array<string>"), ", "), F.lit("]"))
    return table(spark, sf, "documents").select("doc_id", ids.alias("ids"), (F.when(F.col("doc_id") % 2 == 0, "true").otherwise("no") == "true").alias("flag"))


@query("fn_24_language_names", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE lang END AS english, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'Français' WHEN 'de' THEN 'Deutsch' WHEN 'es' THEN 'Español' ELSE lang END AS native, CASE lang WHEN 'en' THEN 'You MUST write your entire response in English only.' WHEN 'fr' THEN 'Vous DEVEZ rédiger toute votre réponse en français uniquement.' WHEN 'de' THEN 'Sie MÜSSEN Ihre gesamte Antwort ausschließlich auf Deutsch verfassen.' WHEN 'es' THEN 'DEBES escribir toda tu respuesta únicamente en español.' ELSE 'You MUST write your entire response in ' || lang || ' only.' END AS instruction FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.language_names(F.concat(F.lit("__label__"), "lang")).alias("n")).select("doc_id", "n.*")


@query("fn_26_27_formats", "SELECT event_id, event_id || '-' || (event_id + 3) AS pages, event_id % 2 = 0 AS is_uuid, printf('%.4f', value) AS score FROM events")
def _(spark, sf):
    made = F.when(F.col("event_id") % 2 == 0, "123E4567-e89b-12d3-a456-426614174000").otherwise("123e4567-e89b")
    return table(spark, sf, "events").select("event_id", text.page_range(F.array("event_id", F.col("event_id") + 3)).alias("pages"), text.is_uuid(made).alias("is_uuid"), text.fixed(F.col("value")).alias("score"))


@query("fn_28_29_vectors", "SELECT vec_id, len(embedding) AS n, round(list_sum([x::DOUBLE for x in embedding]), 6) AS total FROM embeddings")
def _(spark, sf):
    shown = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ", ")
    parsed = table(spark, sf, "embeddings").select("vec_id", text.floats(F.concat(shown, F.lit(", nan, x"))).alias("v"))
    return parsed.select("vec_id", F.size("v").cast("bigint").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@query("fn_30_flt_15_fallbacks", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a|b' ELSE 'q' || doc_id END AS passages FROM documents")
def _(spark, sf):
    given = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a\n"), F.lit("\n \t"), F.lit("\u00a0b"))).otherwise(F.array(F.lit("\n")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.or_query(given, F.concat(F.lit("\n q"), "doc_id", F.lit("\r\n"))), "|").alias("passages"))


# --- conversations --------------------------------------------------------------------------------------------------


def _turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"), (F.col("turn") % 7 == 3).alias("is_triage"))


@query("flt_14_16_usable", "SELECT conv_id, turn FROM conversations WHERE trim(text) <> '' AND turn % 5 <> 2 AND turn % 7 <> 3 AND role = 'user'")
def _(spark, sf):
    """Some contents are line breaks alone."""
    turns = _turns(spark, sf).withColumn("content", F.when(F.col("turn") % 5 == 2, F.lit("\n\t\u00a0")).otherwise(F.concat(F.lit("\n"), "content")))
    return chat.usable(turns).where("role = 'user'").select("conv_id", "turn")


@query("win_5_last_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def _(spark, sf):
    return chat.last_n(_turns(spark, sf), chat.MIXED_TURNS, "conv_id", "turn").select("conv_id", "turn", "role")


@query("win_5_last_user_turns", "SELECT conv_id, turn FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def _(spark, sf):
    return chat.last_n(_turns(spark, sf), 3, "conv_id", "turn", role="user").select("conv_id", "turn")


@query(
    "win_6_budget",
    """WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n,
      sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS rest FROM conversations),
    c AS (SELECT conv_id, coalesce(min(i) FILTER (i % 2 = 0 AND (rest <= 700 OR i >= n - 4)), 0) AS cut FROM p GROUP BY 1)
    SELECT conv_id, turn FROM p JOIN c USING (conv_id) WHERE i >= cut""",
)
def _(spark, sf):
    return chat.budgeted(_turns(spark, sf), "conv_id", "turn", chat.chat_size(F.col("content")), budget=700).select("conv_id", "turn")


@query("agg_12_chat_size", "SELECT conv_id, sum(length(text))::BIGINT AS chars, count(*) AS n, min(turn) AS cursor FROM conversations GROUP BY 1")
def _(spark, sf):
    return _turns(spark, sf).groupBy("conv_id").agg(F.sum(chat.chat_size(F.col("content"))).alias("chars"), F.count("*").alias("n"), F.min("turn").alias("cursor"))


@query(
    "top_6_agg_9_latest_messages",
    """WITH p AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
    SELECT conv_id, turn, total, total > 4 AS has_more FROM p WHERE n <= 4""",
)
def _(spark, sf):
    return chat.latest_with_more(_turns(spark, sf), "conv_id", "turn", 4).select("conv_id", "turn", "total", "has_more")


@query("fn_13_23_history", f"""SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '...' ELSE t END, chr(10) ORDER BY turn) AS history
    FROM (SELECT conv_id, turn, role, {_strip('text')} AS t FROM conversations) GROUP BY 1""")
def _(spark, sf):
    """Answers end in line breaks and a second part, which history leaves out."""
    more = F.when(F.col("role") == "assistant", F.concat("content", F.lit(f"\n\n{text.DETAIL_MARK}\n\n"), "content")).otherwise(F.concat(F.lit("\n"), "content", F.lit(" \n")))
    return chat.history_lines(_turns(spark, sf).withColumn("content", more), "conv_id", "turn", {"user": "User", "assistant": "Assistant"}, most=80)


@query("fn_23_source_blocks", f"SELECT source AS query, piece, string_agg('[' || doc_id || '] ' || lang || ', ' || source || chr(10) || {_strip('text')}, chr(10) || chr(10) ORDER BY doc_id) AS prompt FROM (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100 AS piece FROM documents) GROUP BY 1, 2")
def _(spark, sf):
    hits = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("query"), F.col("lang").alias("book_name"), F.col("source").alias("author"), "text")
    return chat.source_blocks(hits, "query", "id")


@query("agg_2_least_payload", "SELECT source, arg_min(doc_id, n_chars * 1000000 + doc_id) AS doc_id, min(n_chars) AS n_chars FROM documents GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"), F.min("n_chars").alias("n_chars"))


@query("agg_17_last_wins", "SELECT conv_id, arg_max(text, turn) AS content, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def _(spark, sf):
    return chat.last_wins(_turns(spark, sf).select("conv_id", "turn", "content", "role"), "conv_id", "turn").select("conv_id", "content", "role")


@query("agg_14_counts", "SELECT count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, bool_and(quality = 1) AS every, bool_or(toxic = 1) AS some FROM labels")
def _(spark, sf):
    return table(spark, sf, "labels").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.every(F.col("quality") == 1).alias("every"), F.some(F.col("toxic") == 1).alias("some"))


@query("top_13_preview", "SELECT source, list_sort(list(doc_id))[1:3]::VARCHAR AS preview, count(*) > 3 AS more FROM documents GROUP BY 1")
def _(spark, sf):
    first = Window.partitionBy("source").orderBy("doc_id")
    rows = table(spark, sf, "documents").select("source", "doc_id", F.row_number().over(first).alias("n"))
    grouped = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.col("doc_id")))).alias("ids"), F.count("*").alias("all"))
    return grouped.select("source", F.concat(F.lit("["), F.array_join(F.col("ids").cast("array<string>"), ", "), F.lit("]")).alias("preview"), (F.col("all") > 3).alias("more"))


@query("dml_2_touch", "SELECT c.conv_id AS id, greatest(0, max(m.turn)) AS updated_at FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN conversations m USING (conv_id) GROUP BY 1")
def _(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("created_at"))
    heads = turns.select(F.col("conversation_id").alias("id")).distinct().withColumn("updated_at", F.lit(0).cast("long"))
    return chat.touch(heads, turns)


@query("dml_4_cascade_delete", "SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id % 3 <> 0 GROUP BY 1")
def _(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn")
    heads = turns.select(F.col("conversation_id").alias("id")).distinct()
    _, left = chat.delete_conversations(heads, turns, heads.where("id % 3 = 0"))
    return left.groupBy(F.col("conversation_id").alias("conv_id")).agg(F.count("*").alias("n"))


@query("dml_7_routing", "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'conversations' WHEN turn > 0 THEN 'anonymous' END AS target FROM conversations")
def _(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", chat.route(F.col("conv_id") % 2 == 0, F.col("turn") == 0).alias("target"))


@query("ctl_6_goes_on", "SELECT conv_id, turn FROM conversations WHERE turn % 3 = 0 OR length(text) % 2 = 0 OR turn % 5 = 1")
def _(spark, sf):
    intent = F.when(F.col("turn") % 3 == 0, "retrieve").when(F.col("turn") % 5 == 1, F.lit(None).cast("string")).otherwise("smalltalk")
    reply = F.when(F.length("content") % 2 == 0, "\n ").otherwise("hello")
    return _turns(spark, sf).where(chat.goes_on(intent, reply)).select("conv_id", "turn")


# --- JSON and streams -----------------------------------------------------------------------------------------------


@query("src_10_11_ndjson_round_trip", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    noise = spark.createDataFrame([("",), ("{broken",), ("  ",)], "value string")
    return files.parse_ndjson(files.to_ndjson(rows).unionByName(noise), "event_id long, user_id long, event_type string, value double")


@query("src_8_keyed_json", "SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey AS region FROM nation")
def _(spark, sf):
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))))
    return files.keyed_json(table(spark, sf, "nation").agg(F.to_json(pairs).alias("value")), "struct<name:string,region:int>")


@query("src_11_split_stream", "SELECT conv_id AS id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS line_no, 'line ' || turn AS value FROM conversations")
def _(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "turn", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    chunk = F.when(F.col("half") == 0, "li").otherwise(F.concat(F.lit("ne "), "turn", F.lit("\n")))
    return files.split_stream(turns.select("id", (F.col("turn") * 2 + F.col("half")).alias("o"), chunk.alias("chunk")), "id", "o")


@query(
    "src_7_request_documents",
    """SELECT source AS query, piece, count(*) AS n, min(doc_id) AS least, arg_min(doc_id, place) AS first
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place, (place - 1) // 100 AS piece FROM documents) GROUP BY 1, 2""",
)
def _(spark, sf):
    hits = table(spark, sf, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    parsed = files.requests(hits, 100).select("query", "piece", F.from_json("value", "query string, sources array<struct<id:bigint,score:double>>").alias("r"))
    least = F.array_min(F.transform("r.sources", lambda s: s["id"]))
    return parsed.select("query", "piece", F.size("r.sources").cast("bigint").alias("n"), least.alias("least"), F.col("r.sources")[0]["id"].alias("first"))


@query(
    "str_1_src_10_streamed_lines",
    """WITH w AS (SELECT conv_id || '-' || turn AS request_id, string_split(text, ' ') AS words FROM conversations)
    SELECT request_id, 0 AS seq, 'metadata' AS type, NULL::VARCHAR AS delta FROM w
    UNION ALL SELECT request_id, unnest(range(1, len(words) + 1))::INT, 'content', unnest(words) || ' ' FROM w
    UNION ALL SELECT request_id, (len(words) + 1)::INT, 'done', NULL FROM w""",
)
def _(spark, sf):
    """Replies streamed from the table's files through the sink, and read back."""
    asked = spark.readStream.schema(table(spark, sf, "conversations").schema).parquet(f"{sf}/conversations.parque[t]")  # a pattern: a stream takes no single file
    lines = replies.reply_lines(asked.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.col("text").alias("reply")))
    out = new_folder(spark)
    sink.ndjson_sink(lines, f"{out}/lines", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sink.read_sink(spark, f"{out}/lines").select("request_id", "seq", "type", "delta")


@query(
    "dml_1_5_stored_conversations",
    """SELECT conv_id AS id, CASE WHEN conv_id % 5 = 0 THEN 'Renamed' ELSE 'New Conversation' END AS title, count(*) + (conv_id % 2 = 0)::INT AS n
    FROM conversations WHERE conv_id % 3 <> 0 GROUP BY 1 UNION ALL SELECT -1, 'Made', 1""",
)
def _(spark, sf):
    """Conversations and messages as stored tables: created, renamed, added to, deleted with all messages, compacted between."""
    out, turns = new_folder(spark), table(spark, sf, "conversations")
    heads = StoredRows(spark, f"{out}/heads", "id long, title string", "id", buckets=8)
    messages = StoredRows(spark, f"{out}/messages", "id string, conversation_id long, content string", "id", buckets=8)
    heads.append(turns.select(F.col("conv_id").alias("id"), F.lit(chat.DEFAULT_TITLE).alias("title")).distinct())
    messages.append(turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("conversation_id"), F.col("text").alias("content")))
    heads.compact()
    heads.append(heads.read().where("id % 5 = 0").withColumn("title", F.lit("Renamed")))
    heads.append(spark.createDataFrame([(-1, "Made")], "id long, title string"))
    messages.append(spark.createDataFrame([("-1-0", -1, "first")], "id string, conversation_id long, content string"))
    messages.append(heads.read().where("id % 2 = 0").select(F.concat("id", F.lit("-more")).alias("id"), F.col("id").alias("conversation_id"), F.lit("more").alias("content")))
    messages.compact()
    gone = heads.read().where("id >= 0 and id % 3 = 0").select("id")
    messages.delete(messages.read().join(gone.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_semi").select("id"))
    heads.delete(gone)
    heads.compact()
    counted = messages.read().groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("n"))
    return heads.read().join(counted, "id").select("id", "title", "n")


@query("str_1_agg_15_reply_round_trip", "SELECT conv_id || '-' || turn AS request_id, text || ' ' AS content, 'done' AS phase, true AS complete FROM conversations")
def _(spark, sf):
    asked = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.col("text").alias("reply"))
    return replies.assembled(replies.useful(replies.reply_lines(asked))).select("request_id", "content", "phase", "complete")


def _sent(spark, sf):
    """Lines of all turns: every third line twice, every seventh turn is a triage reply, every fifth one lacks its end."""
    asked = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.col("text").alias("reply"), (F.col("turn") % 7 == 3).alias("flag"), "turn")
    lines = replies.reply_lines(asked, triage="flag")
    lines = lines.unionByName(lines.where("seq % 3 = 0"))
    open_ones = asked.where("turn % 5 = 4").select("request_id").withColumn("__open", F.lit(True))
    return lines.join(open_ones, "request_id", "left").where("__open is null or type <> 'done'").drop("__open")


@query("str_2_triage_phases", """SELECT conv_id || '-' || turn AS request_id, turn % 7 = 3 AS is_triage, md5(text || ' ') AS digest,
    CASE WHEN turn % 5 <> 4 THEN 'done' ELSE 'generating' END AS phase, CASE WHEN turn % 7 = 3 THEN 'generating' ELSE 'reading' END AS first_phase FROM conversations""")
def _(spark, sf):
    """Phases of whole replies, and after their first line alone."""
    lines = _sent(spark, sf)
    first = replies.assembled(lines.where("seq = 0")).select("request_id", F.col("phase").alias("first_phase"))
    return replies.assembled(lines).select("request_id", "is_triage", F.md5("content").alias("digest"), "phase").join(first, "request_id")


@query("str_5_accumulated", "SELECT conv_id || '-' || turn AS request_id, turn % 7 = 3 AS is_triage, md5(text || ' ') AS digest, 'done' AS phase, true AS complete FROM conversations WHERE turn % 5 <> 4")
def _(spark, sf):
    """The stateful accumulation, over a table of lines: those that come again change nothing, requests without an end stay open."""
    return replies.accumulated(_sent(spark, sf)).select("request_id", "is_triage", F.md5("content").alias("digest"), "phase", "complete")


@query("str_6_8_incomplete", "SELECT conv_id || '-' || turn AS request_id, CASE WHEN turn % 2 = 0 THEN 'Generation stopped.' ELSE 'part' END AS content FROM conversations")
def _(spark, sf):
    turns = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), "turn")
    lines = turns.select("request_id", F.lit(0).alias("seq"), F.lit("metadata").alias("type"), F.lit(None).cast("string").alias("delta"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("sources"))
    deltas = turns.where("turn % 2 <> 0").select("request_id", F.lit(1).alias("seq"), F.lit("content").alias("type"), F.lit("part").alias("delta"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("sources"))
    return replies.stopped(replies.assembled(lines.unionByName(deltas))).select("request_id", "content")


@query("extension_windowed_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    return replies.windowed_counts(table(spark, sf, "events"))


@query("agg_10_first_seen_names", "SELECT conv_id, string_agg(role, ', ' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    seen = F.array_sort(F.collect_list(F.struct("turn", "role")))
    grouped = _turns(spark, sf).groupBy("conv_id").agg(F.transform(seen, lambda s: s["role"]).alias("roles"))
    return grouped.select("conv_id", F.array_join(F.array_distinct("roles"), ", ").alias("roles"))


@query("set_6_replaced_group", """SELECT c_custkey, array_to_string(list_concat(list_filter(['a', 'z', 'b'], lambda x: NOT list_contains(['a', 'b', 'c'], x)),
    [CASE WHEN c_nationkey % 2 = 0 THEN 'b' ELSE 'c' END]), ',') AS chosen FROM customer""")
def _(spark, sf):
    lit = lambda *v: F.array(*(F.lit(x) for x in v))
    chosen = F.when(F.col("c_nationkey") % 2 == 0, lit("b")).otherwise(lit("c"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(catalog.replaced_group(lit("a", "z", "b"), lit("a", "b", "c"), chosen), ",").alias("chosen"))
