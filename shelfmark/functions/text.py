"""Answers, citations, page HTML and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks in answers and pages.
DETAIL_MARK = "<!-- DETAILED_ANSWER -->"
CITATION = r"\[(\d+(?:\s*[,،]\s*\d+)*)\]"
OPEN_CITATION = r"\[\d+(?:\s*[,،]\s*\d*)*$"
RED_NUMBER = r'<font[^>]*color="#be0000"[^>]*>[\d٠-٩\s\-]+</font>'
BRACKETED_NUMBER = r"\[[\d٠-٩،,\-\s]+\][.،,؛:]?"
ROUND_NUMBER = r"⦗[\d٠-٩\s\-]+⦘"
EMPTY_PARAGRAPHS = r"(?:<p[^>]*>\s*</p>\s*)+"
BREAK = "<br><br>"
RTL = "\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF\u0590-\u05FF"
LTR_WIDE = "A-Za-z\u00C0-\u024F\u0400-\u04FF\u0370-\u03FF"
ID_BASE = 10_000_000


#: White space as browsers and parsers of requests trim it: line breaks, tabs and all spaces of Unicode.
SPACE = r"[\s\p{Z}\uFEFF]"


def stripped(c: Column) -> Column:
    """Without white space at both ends; ``F.trim`` takes spaces alone."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


# --- citations ------------------------------------------------------------------------------------------------------


def cited_ids(c: Column) -> Column:
    """Distinct ids in citations, in order of first mention."""
    lists = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CITATION), F.lit(1))
    parts = F.flatten(F.transform(lists, lambda g: F.split(g, r"\s*[,،]\s*")))
    return F.array_distinct(F.transform(parts, lambda p: p.cast("bigint")))


def citation_groups(c: Column) -> Column:
    """Ids of each run of citations that only spaces and commas part, as they stand: repeats stay."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"{CITATION}(?:[\s,،]*{CITATION})*"), F.lit(0))
    return F.transform(runs, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"\d+"), F.lit(0)), lambda p: p.cast("bigint")))


def text_between_citations(c: Column) -> Column:
    """The parts of the text around runs of citations."""
    return F.split(F.coalesce(c, F.lit("")), rf"{CITATION}(?:[\s,،]*{CITATION})*")


def without_open_citation(c: Column) -> Column:
    """The text without a citation that is still being written at its end."""
    return F.regexp_replace(c, OPEN_CITATION, "")


def book_of(chunk_id: Column) -> Column:
    return F.floor(chunk_id / ID_BASE).cast("bigint")


# --- answers --------------------------------------------------------------------------------------------------------


def simple_answer(c: Column) -> Column:
    return F.when(F.instr(c, DETAIL_MARK) > 0, F.nullif(stripped(F.substring_index(c, DETAIL_MARK, 1)), F.lit(""))).otherwise(c)


def detailed_answer(c: Column) -> Column:
    at = F.instr(c, DETAIL_MARK)
    return F.when(at > 0, F.nullif(stripped(F.substring(c, at + len(DETAIL_MARK), F.length(c))), F.lit("")))


def history_content(role: Column, content: Column) -> Column:
    """What of a message goes into the next prompt: of an answer, only what stands before the mark."""
    return F.when((role == "assistant") & (F.instr(content, DETAIL_MARK) > 0), stripped(F.substring_index(content, DETAIL_MARK, 1))).otherwise(content)


def shortened(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def cut_with_dots(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def word_stream(c: Column) -> Column:
    """The words of a reply as deltas, each followed by a space."""
    return F.transform(F.split(c, " "), lambda w: F.concat(w, F.lit(" ")))


# --- pages ----------------------------------------------------------------------------------------------------------


def clean_html(c: Column) -> Column:
    """Without note numbers, and runs of empty paragraphs as a break; in this order."""
    for pattern, put in ((RED_NUMBER, ""), (BRACKETED_NUMBER, ""), (ROUND_NUMBER, ""), (EMPTY_PARAGRAPHS, BREAK)):
        c = F.regexp_replace(c, pattern, put)
    return c


def spliced_html(pages: Column) -> Column:
    """Pages of one group, one after the other; a closing div before the next page gets a break."""
    n = F.size(pages)
    return F.array_join(F.transform(pages, lambda p, i: F.when(i < n - 1, F.regexp_replace(p, r"</div>\s*$", "</div>" + BREAK)).otherwise(p)), "")


def direction(c: Column) -> Column:
    """rtl if the first 200 characters have more right-to-left letters than a-z."""
    head = F.substring(F.coalesce(c, F.lit("")), 1, 200)
    count = lambda chars: F.length(F.regexp_replace(head, f"[^{chars}]+", ""))
    return F.when(count(RTL) > count("A-Za-z"), "rtl").otherwise("ltr")


def direction_of_all(c: Column) -> Column:
    """As ``direction``, over the whole text and with more left-to-right scripts."""
    whole = F.coalesce(c, F.lit(""))
    count = lambda chars: F.length(F.regexp_replace(whole, f"[^{chars}]+", ""))  # noqa: E731  runs go at once
    return F.when(whole.rlike(f"[^{SPACE[1:]}") & (count(RTL) > count(LTR_WIDE)), "rtl").otherwise("ltr")


# --- values ---------------------------------------------------------------------------------------------------------


def positive_ints(c: Column) -> Column:
    """A comma list as positive integers; what is no number goes, and nothing left is null."""
    found = F.filter(F.transform(F.split(c, ","), lambda p: stripped(p).try_cast("bigint")), lambda v: v > 0)
    return F.when(F.size(found) > 0, found)


def floats(c: Column) -> Column:
    """A comma list as doubles; what is no number goes."""
    return F.filter(F.transform(F.split(c, ","), lambda p: stripped(p).try_cast("double")), lambda v: v.isNotNull() & ~F.isnan(v))


def sparse_json(c: Column) -> Column:
    """A JSON object of numbers as a map with whole-number keys; keys that are none go."""
    entries = F.filter(F.map_entries(F.from_json(c, "map<string,double>")), lambda e: e["key"].try_cast("bigint").isNotNull())
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].cast("bigint"), e["value"])))


def sparse_indices(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def sparse_values(m: Column) -> Column:
    """Values in order of their indices."""
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: e["value"])


def sparse_items(m: Column) -> Column:
    """A list of (index, value)."""
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: F.struct(e["key"].alias("index"), e["value"].alias("value")))


def dense(m: Column, size: int) -> Column:
    """All ``size`` places, 0 where the map has none."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(m, i.cast("bigint")), F.lit(0.0)))


def request_id(now: Column) -> Column:
    return F.concat(F.lit("req_"), millis(now).cast("string"))


def random_id(now: Column) -> Column:
    """Milliseconds since 1970 and seven random letters or digits; another one for each row and run."""
    letters = F.lit("0123456789abcdefghijklmnopqrstuvwxyz")
    return F.concat(millis(now).cast("string"), F.lit("-"), *(F.substring(letters, (F.floor(F.rand() * 36) + 1).cast("int"), F.lit(1)) for _ in range(7)))


def uuid4() -> Column:
    """A random UUID of version 4; another one for each row and run."""
    return F.uuid()


def leading_digits(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(\d+)", 1), F.lit(""))


def kept_strings(c: Column) -> Column:
    """Trimmed strings without blank ones."""
    return F.filter(F.transform(c, lambda v: stripped(v)), lambda v: v != "")


def or_query(values: Column, query: Column) -> Column:
    """The values, or the query alone if there are none."""
    found = kept_strings(F.coalesce(values, F.array()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(stripped(query)))


def millis(at: Column) -> Column:
    """Milliseconds since 1970 of a time with or without a zone."""
    return F.unix_millis(at.cast("timestamp"))


def relative_time(at: Column, now: Column) -> Column:
    """Time of today, Yesterday, n days ago, or month and day; days are whole 24 hours between the two."""
    days = F.floor((millis(now) - millis(at)) / 86_400_000)
    return (
        F.when(days == 0, F.date_format(at, "hh:mm a")).when(days == 1, "Yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(at, "MMM d"))
    )


def iso_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_uuid(c: Column) -> Column:
    return c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def fixed(c: Column, places: int = 4) -> Column:
    return F.format_string(f"%.{places}f", c)


def page_range(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), "-")


# Language codes with English name, native name, and the instruction to answer in that language.
LANGUAGES = {
    "ar": ("Arabic", "العربية", "يجب أن تكتب إجابتك بالكامل باللغة العربية فقط."),
    "en": ("English", "English", "You MUST write your entire response in English only."),
    "fr": ("French", "Français", "Vous DEVEZ rédiger toute votre réponse en français uniquement."),
    "de": ("German", "Deutsch", "Sie MÜSSEN Ihre gesamte Antwort ausschließlich auf Deutsch verfassen."),
    "es": ("Spanish", "Español", "DEBES escribir toda tu respuesta únicamente en español."),
    "tr": ("Turkish", "Türkçe", "Yanıtınızın tamamını yalnızca Türkçe olarak yazmalısınız."),
    "ur": ("Urdu", "اردو", "آپ کو اپنا پورا جواب صرف اردو میں لکھنا ہے۔"),
    "fa": ("Persian", "فارسی", "شما باید تمام پاسخ خود را فقط به زبان فارسی بنویسید."),
    "id": ("Indonesian", "Bahasa Indonesia", "Anda HARUS menulis seluruh jawaban Anda hanya dalam Bahasa Indonesia."),
    "ms": ("Malay", "Bahasa Melayu", "Anda MESTI menulis seluruh jawapan anda dalam Bahasa Melayu sahaja."),
    "bn": ("Bengali", "বাংলা", "আপনাকে অবশ্যই আপনার সম্পূর্ণ উত্তর শুধুমাত্র বাংলায় লিখতে হবে।"),
    "hi": ("Hindi", "हिन्दी", "आपको अपना पूरा उत्तर केवल हिंदी में लिखना होगा।"),
    "sw": ("Swahili", "Kiswahili", "Lazima uandike jibu lako lote kwa Kiswahili pekee."),
    "ru": ("Russian", "Русский", "Вы ДОЛЖНЫ написать весь свой ответ только на русском языке."),
    "zh": ("Chinese", "中文", "你必须完全用中文撰写你的回答。"),
    "ja": ("Japanese", "日本語", "回答はすべて日本語のみで記述してください。"),
    "ko": ("Korean", "한국어", "반드시 전체 답변을 한국어로만 작성해야 합니다."),
    "pt": ("Portuguese", "Português", "Você DEVE escrever toda a sua resposta apenas em português."),
    "it": ("Italian", "Italiano", "DEVI scrivere tutta la tua risposta esclusivamente in italiano."),
    "nl": ("Dutch", "Nederlands", "U MOET uw volledige antwoord uitsluitend in het Nederlands schrijven."),
}


def language_names(code: Column) -> Column:
    """English and native name of a language code, and the instruction to answer in it.

    ``__label__`` and line breaks are dropped; an unknown code stands for its own names in an English instruction.
    """
    clean = stripped(F.replace(F.replace(code, F.lit("__label__"), F.lit("")), F.lit("\n"), F.lit(" ")))
    unknown = (clean, clean, F.concat(F.lit("You MUST write your entire response in "), clean, F.lit(" only.")))
    maps = [F.create_map(*(F.lit(x) for k, v in LANGUAGES.items() for x in (k, v[i]))) for i in range(3)]
    return F.struct(*(F.coalesce(F.try_element_at(m, clean), u).alias(n) for m, u, n in zip(maps, unknown, ("english", "native", "instruction"))))
