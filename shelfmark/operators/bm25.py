"""BM25 over DataFrames: a fitted model is three tables, and queries are rows."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions.arabic import TOKENS, arabic_tokens, stop_words
from shelfmark.session import spread, stored

#: Query terms that are broadcast to the tokens of the corpus, at about 50 bytes each; more are joined by a shuffle.
BROADCAST_TERMS = 200_000


@dataclass(frozen=True)
class Bm25Config:
    """Parameters of the scoring and of the tokens; ``charset`` is arabic (normalised, stemmed) or unicode.

    ``method`` is the formula, of which there is one; ``delta`` and ``remove_diacritics`` are kept in the record and have
    no effect on it (diacritics go whenever texts are normalised).
    """

    k1: float = 1.5
    b: float = 0.75
    charset: str = "arabic"
    apply_stemming: bool = True
    remove_stopwords: bool = True
    min_token_length: int = 2
    custom_stopwords: tuple[str, ...] = ()
    delta: float = 0.5
    method: str = "lucene"
    normalize: bool = True
    remove_diacritics: bool = True
    min_stem_length: int = 3

    def __post_init__(self):
        if self.method != "lucene":
            raise ValueError("the method is lucene")

    def to_dict(self) -> dict:
        """The record without custom stop-words."""
        return {k: v for k, v in asdict(self).items() if k != "custom_stopwords"}

    @classmethod
    def from_dict(cls, found: dict) -> Bm25Config:
        return cls(**{k: v for k, v in found.items() if k != "custom_stopwords"})

    def tokens(self, c: Column) -> Column:
        if self.charset != "arabic":
            return TOKENS[self.charset](c)
        stops = (*stop_words(), *self.custom_stopwords) if self.remove_stopwords else ()
        return arabic_tokens(c, self.apply_stemming, stops, self.min_token_length, self.min_stem_length, self.normalize)


def term_frequencies(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``key, term, tf, dl``: how often each term occurs in each document, and the document's length."""
    return _counted(_exploded(docs, key, tokens), key)


def _exploded(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    # an outer explode: for an inner one Spark adds a filter on the tokens, which makes them once more below the exchange
    rows = docs.select(F.col(key), tokens.alias("tokens")).select(key, F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term"))
    return rows.where(F.col("term").isNotNull())


def _counted(words: DataFrame, key: str) -> DataFrame:
    """Words are dealt by document, so that what groups by document afterwards needs no other shuffle."""
    return words.repartition(key).groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))


@dataclass
class Bm25Model:
    """``terms(term, idx, df, idf)``, ``postings(doc_id, term, tf, dl)``, ``docs(doc_id, dl)``, one-row ``stats(n, avgdl)``.

    All are plans until they are used. A search reads only what it asks for: the query's terms meet the tokens before
    these are counted, so that the rest of the corpus is not shuffled, and terms are numbered for the encoders alone.
    """

    config: Bm25Config
    terms: DataFrame
    postings: DataFrame
    docs: DataFrame
    stats: DataFrame
    words: DataFrame | None = None

    @classmethod
    def fit(cls, corpus: DataFrame, config: Bm25Config | None = None, key: str = "doc_id", text: str = "text") -> Bm25Model:
        """An empty corpus is an error."""
        config = config or Bm25Config()
        if corpus.isEmpty():
            raise ValueError("the corpus is empty")
        tokens = config.tokens(F.col(text))
        rows = spread(corpus.select(F.col(key).alias("doc_id"), text))
        docs = rows.select("doc_id", F.size(tokens).alias("dl"))
        words = _exploded(rows, "doc_id", tokens)
        postings = _counted(words, "doc_id")
        stats = docs.agg(F.count("*").alias("n"), F.sum("dl").alias("total")).select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl"))
        return cls(config, numbered(inverse_frequencies(postings, stats), "term", "idx"), postings, docs, stats, words)

    def kept(self) -> Bm25Model:
        """The model with stored postings, which terms and statistics come from: the corpus is cut into tokens once."""
        held = stored(self.postings)
        counted = self.docs.agg(F.count("*").alias("n")).crossJoin(held.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total")))
        stats = counted.select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl"))
        return Bm25Model(self.config, numbered(inverse_frequencies(held, stats), "term", "idx"), held, self.docs, stats)

    def weights(self) -> DataFrame:
        """``id, term, weight`` of all postings: idf times the normalised frequency."""
        # one shuffle by term serves the counts and the join, and what groups by term afterwards
        held = self.postings.repartition("term")
        joined = held.crossJoin(F.broadcast(self.stats)).join(inverse_frequencies(held, self.stats).hint("shuffle_hash"), "term")
        return joined.select(F.col("doc_id").alias("id"), "term", (F.col("idf") * self._tf_norm()).alias("weight"))

    def _tf_norm(self) -> Column:
        c = self.config
        return F.col("tf") * (c.k1 + 1) / (F.col("tf") + c.k1 * (1 - c.b + c.b * F.col("dl") / F.col("avgdl")))

    def weighted(self, asked: DataFrame, few: bool | None = None) -> DataFrame:
        """``doc_id, term, df, idf, tf_norm`` of the postings of the terms in ``asked(term)``."""
        few = is_small(asked) if few is None else few
        wanted = small(asked.select("term").distinct(), few)
        if self.words is None:
            held = self.postings.join(wanted, "term", "left_semi")
        else:
            held = _counted(self.words.join(wanted, "term", "left_semi"), "doc_id")
        idf = inverse_frequencies(held, self.stats)
        joined = held.crossJoin(F.broadcast(self.stats)).join(small(idf, few), "term")
        return joined.select("doc_id", "term", "df", "idf", self._tf_norm().alias("tf_norm"))

    def query_terms(self, queries: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
        return term_frequencies(queries.select(F.col(key).alias("query_id"), text), "query_id", self.config.tokens(F.col(text))).select("query_id", "term", F.col("tf").alias("qtf"))

    def scores(self, queries: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
        """``query_id, doc_id, score`` where a document has a query's term; repeated query tokens add repeatedly."""
        asked = self.query_terms(queries, key, text)
        few = is_small(asked)
        joined = self.weighted(asked, few).join(small(asked, few), "term")
        return joined.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * F.col("idf") * F.col("tf_norm")).alias("score"))

    def search(self, queries: DataFrame, k: int = 10, key: str = "query_id", text: str = "text", digits: int = 6) -> DataFrame:
        """The k best documents of each query with tokens; ties by id. Scores of zero do not fill up to k."""
        return top_k(self.scores(queries, key, text).withColumn("score", F.round("score", digits)), k, "query_id", [F.desc("score"), F.asc("doc_id")])

    def search_filled(self, queries: DataFrame, k: int = 10, key: str = "query_id", text: str = "text", digits: int = 6) -> DataFrame:
        """As ``search``, with documents of score 0, least ids first, where a query has fewer than k hits.

        Only the k least ids can fill a query up, so these and not all documents meet the queries.
        """
        hits = stored(self.search(queries, 2 * k, key, text, digits).drop("rank"))  # read twice
        asked = self.query_terms(queries, key, text).select("query_id").distinct()
        least = self.docs.select("doc_id").orderBy("doc_id").limit(2 * k)
        zeros = asked.crossJoin(F.broadcast(least)).join(hits, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit(0.0).alias("score"))
        return top_k(hits.unionByName(zeros), k, "query_id", [F.desc("score"), F.asc("doc_id")])

    def encode_documents(self) -> DataFrame:
        """``doc_id, sparse_vector``: term index to weight, positive weights only, in order of the index."""
        # terms are hashed, so that the postings of the whole corpus are not sorted by them
        joined = self.postings.crossJoin(F.broadcast(self.stats)).join(self.terms.select("term", "idx", "idf").hint("shuffle_hash"), "term")
        weighted = joined.select("doc_id", "idx", (F.col("idf") * self._tf_norm()).alias("weight"))
        return self.docs.select("doc_id").join(sparse_vectors(weighted, "doc_id"), "doc_id", "left")

    def encode_queries(self, queries: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
        """``query_id, sparse_vector`` with weights qtf * idf; terms that the corpus lacks are dropped."""
        weighted = self.query_terms(queries, key, text).join(self.terms, "term").select("query_id", "idx", (F.col("qtf") * F.col("idf")).alias("weight"))
        return sparse_vectors(weighted, "query_id")

    def encode(self, texts: DataFrame, is_query: bool = False, key: str = "text_id", text: str = "text") -> DataFrame:
        """``key, sparse_vector`` of any texts: as queries, or as documents by the corpus's statistics; terms that the
        corpus lacks are dropped, and a text without any has a null vector."""
        if is_query:
            made = self.encode_queries(texts, key, text).withColumnRenamed("query_id", key)
        else:
            found = term_frequencies(texts.select(key, text), key, self.config.tokens(F.col(text)))
            joined = found.crossJoin(F.broadcast(self.stats)).join(self.terms.select("term", "idx", "idf"), "term")
            made = sparse_vectors(joined.select(key, "idx", (F.col("idf") * self._tf_norm()).alias("weight")), key)
        return texts.select(key).join(made, key, "left")

    def idf(self, terms: list[str]) -> DataFrame:
        """``term, idf``; null for a term that the corpus lacks."""
        asked = self.terms.sparkSession.createDataFrame([(t,) for t in terms], "term string")
        return asked.join(self.terms.select("term", "idf"), "term", "left")

    def vocab(self) -> DataFrame:
        """``term, idx``: the whole vocabulary."""
        return self.terms.select("term", "idx")

    def vocab_size(self) -> int:
        return self.terms.count()

    def save(self, path: str) -> None:
        """Three tables and one row of settings (custom stop-words are not saved)."""
        settings = self.config.to_dict()
        for name in ("terms", "postings", "docs", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        self.terms.sparkSession.createDataFrame([settings]).write.mode("overwrite").parquet(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bm25Model:
        settings = spark.read.parquet(f"{path}/config").first().asDict()
        return cls(Bm25Config.from_dict(settings), *(spark.read.parquet(f"{path}/{n}") for n in ("terms", "postings", "docs", "stats")))


def is_small(asked: DataFrame) -> bool:
    return asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS


def small(rows: DataFrame, known: bool) -> DataFrame:
    """A broadcast where the rows are known to be few."""
    return F.broadcast(rows) if known else rows


def inverse_frequencies(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """``term, df, idf`` of all terms in the postings."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return df.crossJoin(F.broadcast(stats)).select("term", "df", idf.alias("idf"))


def fit_per_request(texts: DataFrame, config: Bm25Config | None = None, request: str = "request_id", key: str = "text_id", text: str = "text") -> DataFrame:
    """``request_id, text_id, sparse_vector``: each request's few texts are a corpus of their own, and its queries."""
    config = config or Bm25Config()
    tokens = config.tokens(F.col(text))
    tf = texts.select(request, key, F.explode(tokens).alias("term")).groupBy(request, key, "term").agg(F.count("*").alias("tf"))
    n = texts.groupBy(request).agg(F.count("*").alias("n"))
    df = tf.groupBy(request, "term").agg(F.count("*").alias("df"))
    terms = df.join(n, request).select(
        request, "term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"), (F.row_number().over(Window.partitionBy(request).orderBy("term")) - 1).alias("idx")
    )
    weighted = tf.join(terms, [request, "term"]).select(request, key, "idx", (F.col("tf") * F.col("idf")).alias("weight"))
    return sparse_vectors(weighted, request, key)


def sparse_vectors(weighted: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, idx, weight) as one map for each key, in order of idx."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("idx").cast("bigint").alias("key"), F.col("weight").alias("value"))))
    return weighted.where("weight > 0").groupBy(*keys).agg(F.map_from_entries(entries).alias("sparse_vector"))


def top_k(rows: DataFrame, k: int, by: str | list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each group, with their rank; Spark limits groups before the shuffle."""
    window = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window).cast("bigint")).where(F.col("rank") <= k)


def numbered(rows: DataFrame, order: str, name: str, prefix: int = 3) -> DataFrame:
    """Rows with their 0-based place in the order of a distinct string key, without sorting all of them in one task.

    A key's first characters order as the keys do: rows are counted by prefix, the counts of earlier prefixes are summed
    over that small table, and added to the place inside the prefix.
    """
    dealt = rows.withColumn("__prefix", F.substring(order, 1, prefix))
    earlier = Window.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("__prefix").agg(F.count("*").alias("__n")).select("__prefix", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__prefix").orderBy(order)) - 1
    placed = dealt.withColumn("__inside", inside).join(before, "__prefix")
    return placed.withColumn(name, (F.col("__before") + F.col("__inside")).cast("bigint")).drop("__prefix", "__before", "__inside")
