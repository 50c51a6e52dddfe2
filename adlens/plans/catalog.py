"""The query catalogue: one function ``(spark, sf_dir) -> DataFrame`` per operator group.

Result columns are flat and named the same as in the SQL oracle (``plans/oracle.py``):
arrays are joined into strings, floats are rounded, no wall-clock values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.functions.text import keyword_tokens
from adlens.operators import analytics, corpus, keywords, search, tagger
from adlens.operators.classify import CategoryModel
from adlens.operators.vectors import category_vectors, doc_vectors
from adlens.operators import word2vec
from adlens.plans import standins
from adlens.schemas import DEFAULT_CATEGORY_ORDER, UNKNOWN_CATEGORY
from adlens.session import materialize_path, scratch_dir
from adlens.sources import collection, keyword_index, message_log, paths, rollups, text as textio
from adlens.sources.stream import message_log_options, read_stream
from adlens.streaming import enrich

# Query parameters (the oracle uses the same values).
SEARCH_CATEGORY = "src3"
SEARCH_KEYWORDS = ("der", "les", "hotel")
FIRST_N = 200
# A small part-of-speech lexicon (token in its original case -> tag).
LEXICON = (
    ("It", "PRP"), ("it", "PRP"), ("Le", "DT"), ("le", "DT"), ("La", "DT"), ("la", "DT"),
    ("les", "DT"), ("des", "DT"), ("de", "IN"), ("Der", "DT"), ("der", "DT"), ("die", "DT"),
    ("und", "CC"), ("el", "DT"), ("en", "IN"), ("y", "CC"), ("only", "JJ"), ("early", "JJ"),
)

# A lexicon of words with several tags (token, tag, cost), for tags in context.
CONTEXT_LEXICON = (
    ("la", "DT", 100), ("la", "PRP", 900), ("le", "DT", 100), ("le", "PRP", 900), ("les", "DT", 100), ("les", "PRP", 900),
    ("que", "IN", 300), ("que", "PRP", 300), ("en", "IN", 200), ("en", "PRP", 700), ("die", "DT", 100), ("die", "VB", 1200),
    ("der", "DT", 100), ("der", "PRP", 1100), ("that", "IN", 400), ("that", "DT", 400), ("thing", "NN", 100), ("thing", "VB", 1500),
    ("in", "IN", 0), ("in", "RP", 1500), ("only", "JJ", 500), ("only", "RB", 300), ("and", "CC", 0), ("the", "DT", 0),
    ("has", "VBZ", 100), ("un", "DT", 200), ("un", "CD", 900), ("des", "DT", 300), ("des", "IN", 500), ("con", "IN", 100),
    ("con", "NN", 1200), ("de", "IN", 0), ("und", "CC", 0), ("y", "CC", 0), ("to", "IN", 200), ("to", "RP", 600),
    ("on", "IN", 300), ("on", "RP", 500), ("on", "PRP", 800), ("el", "DT", 50), ("est", "VBZ", 300), ("est", "NN", 600),
)

Query = Callable[[SparkSession, str], DataFrame]


def _joined(c: str, sep: str = ",") -> F.Column:
    return F.array_join(F.col(c), sep).alias(c)


def _keyworded(spark: SparkSession, sf_dir: str, lexicon: DataFrame | None = None, linked: bool = True) -> DataFrame:
    """PR5; ``linked``: with url and title (a join to the web pages)."""
    pages = standins.linked_pages(spark, sf_dir) if linked else standins.text_pages(spark, sf_dir)
    return keywords.pages_with_keywords(pages, "doc_id", lexicon=lexicon)


def _collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO4 then IO5: the keyworded pages stored partitioned by category (indexed once per
    application, as the reference's searches read its index), read back."""
    def build() -> str:
        path = scratch_dir(spark, "pages-collection")
        collection.initialize(spark, path)
        collection.save(_keyworded(spark, sf_dir), path)
        return path
    key = T.StructField("doc_id", T.LongType())
    return collection.read(spark, standins.stored(spark, sf_dir, "collection", build),
                           schema=collection.collection_schema(key))


def _indexed(spark: SparkSession, sf_dir: str, words, category=None) -> DataFrame:
    """A keyword search of the stored collection through its inverted index (built once, as it)."""
    pages = _collection(spark, sf_dir)

    def build() -> str:
        path = scratch_dir(spark, "keyword-index")
        keyword_index.build(pages, path, "doc_id")
        return path
    return keyword_index.search(pages, standins.stored(spark, sf_dir, "keyword-index", build), "doc_id", words, category)


def _hits(df: DataFrame) -> DataFrame:
    return search.hits(df, "doc_id").select("doc_id", "url", "title", "category", "author",
                                            "publishedAt", _joined("keywords"))


# --- keywords ---------------------------------------------------------------------------

def q_tokenize(spark, sf_dir):
    """TX1 + TX4: the page's tokens of all classes, lower-cased, in text order."""
    p = standins.text_pages(spark, sf_dir)
    toks = F.transform(keyword_tokens("content"), lambda t: F.lower(t))
    return p.select("doc_id", toks.alias("_t")).select(
        "doc_id", F.size("_t").cast("bigint").alias("n_tokens"), F.array_join("_t", " ").alias("tokens"))


def q_keyword_counts(spark, sf_dir):
    """AG1 + FI5/FI6: (doc_id, keyword, n)."""
    return keywords.keyword_counts(standins.text_pages(spark, sf_dir), "doc_id", "content")


def q_keywords_top10(spark, sf_dir):
    """TK1: the ten most frequent keywords per page."""
    return _keyworded(spark, sf_dir, linked=False).select("doc_id", _joined("keywords"))


def q_keywords_page(spark, sf_dir):
    """PR5: the S3 page rows."""
    k = _keyworded(spark, sf_dir)
    return k.select("doc_id", "url", "title", "content", "category", "author", "publishedAt",
                    _joined("keywords"))


def lexicon_df(spark) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), "token string, tag string")


def q_keywords_by_tag(spark, sf_dir):
    """TX3 with a lexicon + FI6: top-10 keywords when a tag lexicon overrides the rules."""
    return _keyworded(spark, sf_dir, lexicon_df(spark), linked=False).select("doc_id", _joined("keywords"))


def q_keywords_by_large_lexicon(spark, sf_dir):
    """TX3 as a lexicon too large for the plan is worked: the corpus's own words ending in -en, tagged
    adverbs (so dropped), beside the small lexicon."""
    pages = standins.text_pages(spark, sf_dir)
    words = pages.select(F.explode_outer(keyword_tokens("content")).alias("token")).where("token LIKE '%en'").distinct()
    lexicon = lexicon_df(spark).unionByName(words.join(lexicon_df(spark), "token", "left_anti").select("token", F.lit("RB").alias("tag")))
    lexicon = spark.read.parquet(standins.stored(spark, sf_dir, "lexicon", lambda: materialize_path(lexicon, "lexicon")))
    counts = keywords.joined_keywords(pages, lexicon)
    return counts.select("doc_id", _joined("keywords"))


def q_keywords_by_context(spark, sf_dir):
    """TX3 with neighbours: top-10 keywords by tags in context, transitions learned from all pages."""
    pages = standins.text_pages(spark, sf_dir)
    words = spark.createDataFrame(list(CONTEXT_LEXICON), "token string, tag string, cost int")
    learned = tagger.learn_transitions(pages, tagger.tagger(words))
    found = tagger.extract_keywords(pages, tagger.tagger(words, learned))
    return found.select("doc_id", _joined("keywords"))


# --- search (over the stored collection) --------------------------------------------

def q_by_category(spark, sf_dir):
    """FI1 + PR6: a category prune on the stored collection."""
    return _hits(search.by_category(_collection(spark, sf_dir), SEARCH_CATEGORY))


def q_by_keywords(spark, sf_dir):
    """FI2/AR1 + PR6: any of the keywords, by the inverted index."""
    return _hits(_indexed(spark, sf_dir, SEARCH_KEYWORDS))


def q_search_both(spark, sf_dir):
    """FI3 + PR6: category and any keyword."""
    return _hits(search.search(_collection(spark, sf_dir), SEARCH_KEYWORDS, SEARCH_CATEGORY))


def q_search_keywords_only(spark, sf_dir):
    """FI4 + PR6: empty category means keyword-only; by the inverted index."""
    return _hits(_indexed(spark, sf_dir, SEARCH_KEYWORDS, ""))


def q_search_indexed(spark, sf_dir):
    """FI3 + PR6: category and any keyword, by the inverted index."""
    return _hits(_indexed(spark, sf_dir, SEARCH_KEYWORDS, SEARCH_CATEGORY))


def q_keyword_postings(spark, sf_dir):
    """The whole inverted index: pages of every keyword and category."""
    found = keyword_index.postings(_collection(spark, sf_dir), "doc_id")
    return found.groupBy("keyword", "category").agg(F.count("*").alias("pages"))


def q_search_total(spark, sf_dir):
    """AG8: number of hits of the two-argument search."""
    return search.total(search.search(_collection(spark, sf_dir), SEARCH_KEYWORDS, SEARCH_CATEGORY))


# --- analytics --------------------------------------------------------------------------

def q_pages_per_category(spark, sf_dir):
    return analytics.pages_per_category(standins.pages(spark, sf_dir))


def q_pages_per_category_top10(spark, sf_dir):
    """TK2: the ten largest categories."""
    return analytics.pages_per_category(standins.pages(spark, sf_dir), 10)


def q_top_keywords_per_category(spark, sf_dir):
    """AG3 (flagship): top 5 keywords per category over the keyworded pages."""
    top = analytics.top_keywords_per_category(_keyworded(spark, sf_dir, linked=False))
    return top.select("category", _joined("keywords"))


def q_pages_per_hour(spark, sf_dir):
    return analytics.pages_per_period(standins.timestamped(spark, sf_dir), "hour")


def q_pages_per_day(spark, sf_dir):
    return analytics.pages_per_period(standins.timestamped(spark, sf_dir), "DAY")


def _grown(spark, sf_dir) -> str:
    """A collection saved in three writes, one of them twice, with its counts kept; two are compacted."""
    def build() -> str:
        path = scratch_dir(spark, "grown")
        pages = _keyworded(spark, sf_dir, linked=False).withColumn(
            "timestamp", F.lit(1704067200000) + F.col("doc_id") * 977_000)
        for part, write_id in ((0, "first"), (1, "second"), (1, "second")):
            rollups.save(pages.where(F.pmod("doc_id", F.lit(3)) == part), path, write_id)
        collection.compact(spark, path)
        collection.save(pages.where(F.pmod("doc_id", F.lit(3)) == 2), path)  # its counts are taken by the next report
        return path
    return standins.stored(spark, sf_dir, "grown", build)


def q_rollup_per_category(spark, sf_dir):
    """AG2 from the counts kept at each write."""
    return rollups.pages_per_category(spark, _grown(spark, sf_dir))


def q_rollup_top_keywords(spark, sf_dir):
    """AG3 from the counts kept at each write."""
    return rollups.top_keywords_per_category(spark, _grown(spark, sf_dir)).select("category", _joined("keywords"))


def q_rollup_per_hour(spark, sf_dir):
    """AG4 from the counts kept at each write."""
    return rollups.pages_per_period(spark, _grown(spark, sf_dir), "hour")


def q_rollup_per_day(spark, sf_dir):
    return rollups.pages_per_period(spark, _grown(spark, sf_dir), "day")


def q_json_fields(spark, sf_dir):
    """PR1-PR3/JS1: message bytes -> string -> from_json -> flattened field."""
    ev = standins.table(spark, sf_dir, "events")
    raw = ev.select("event_id", F.encode("props", "UTF-8").alias("value"))
    parsed = (raw.select("event_id", F.col("value").cast("string").alias("json"))
              .select("event_id", F.from_json("json", "k bigint").alias("data"))
              .select("event_id", "data.*"))
    return parsed


# --- vectors and classification -------------------------------------------------------

def _model(spark, sf_dir, gathered: bool = True) -> CategoryModel:
    vocab = standins.vocabulary(spark, sf_dir)
    return CategoryModel(vocab, standins.categories(vocab), gathered=gathered)


def q_doc_vector_norm(spark, sf_dir):
    """AG5/JN1: norm of each page's mean vector, rounded to 6 places."""
    dv = _model(spark, sf_dir).doc_vectors(standins.text_pages(spark, sf_dir))
    return _norms(dv)


def q_doc_vector_norm_joined(spark, sf_dir):
    """AG5/JN1 as a vocabulary above the broadcast budget is worked: tokens joined, vectors summed by key."""
    return _norms(doc_vectors(standins.text_pages(spark, sf_dir), standins.vocabulary(spark, sf_dir), max_broadcast_bytes=0))


def _norms(dv: DataFrame) -> DataFrame:
    return dv.select("doc_id", F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 6)
                     .alias("norm"), "n_known")


def q_category_centroid(spark, sf_dir):
    """AG6: one row per (category, dimension), rounded."""
    vocab = standins.vocabulary(spark, sf_dir)
    cv = category_vectors(standins.categories(vocab), vocab)
    return cv.select("category", F.posexplode("vector").alias("dim", "value")) \
        .select("category", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def q_cosine_per_category(spark, sf_dir):
    """MA1/JN2: similarity of every page with every category centroid, rounded."""
    res = _model(spark, sf_dir).transform(standins.text_pages(spark, sf_dir), with_similarities=True)
    return res.select("doc_id", F.inline_outer("similarities")).filter(F.col("category").isNotNull()) \
        .select("doc_id", "category", F.round("similarity", 6).alias("similarity"))


def q_classify(spark, sf_dir):
    """ML2/AG7: the category of each page."""
    return _model(spark, sf_dir).transform(standins.text_pages(spark, sf_dir))


def q_classify_bucketed(spark, sf_dir):
    """ML2 on the page table stored bucketed by key: the per-page aggregation reuses the
    scan's partitioning, so the plan has no shuffle (only the vocabulary broadcast)."""
    return _model(spark, sf_dir, gathered=False).transform(standins.bucketed_pages(spark, sf_dir))


# --- corpus -----------------------------------------------------------------------------

def q_label_lines(spark, sf_dir):
    """TX5/TX6/TX8: labelled training lines."""
    return corpus.label_lines(standins.labelled_examples(spark, sf_dir)).select("doc_id", "value")


def _written_corpus(spark, sf_dir) -> DataFrame:
    lines = corpus.label_lines(standins.labelled_examples(spark, sf_dir))
    path = scratch_dir(spark, "corpus")
    textio.write_lines(lines, path)
    return textio.read_lines(spark, path)


def q_label_parse(spark, sf_dir):
    """IO9 -> IO10 -> FI8/FI9/TX7: write the corpus as text, read lines, parse."""
    return corpus.parse_lines(_written_corpus(spark, sf_dir)).select("category", "content")


def q_label_parse_all(spark, sf_dir):
    """As label_parse, with labels of any non-space characters: every example comes back."""
    return corpus.parse_lines(_written_corpus(spark, sf_dir), pattern=corpus.ANY_LABEL_PATTERN) \
        .select("category", "content")


def q_dropped_lines(spark, sf_dir):
    """How many lines the default label pattern leaves out."""
    return corpus.dropped_lines(_written_corpus(spark, sf_dir))


def q_first_n(spark, sf_dir):
    """IO8/TK3: the first 200 examples by key."""
    d = standins.table(spark, sf_dir, "documents")
    return corpus.first_rows(d.select("doc_id", "source", "n_chars"), "doc_id", FIRST_N)


# --- storage ----------------------------------------------------------------------------

def q_collection_roundtrip(spark, sf_dir):
    """IO7 -> IO4 -> IO5: create, append keyworded pages, read one category back."""
    path = scratch_dir(spark, "collection")
    collection.initialize(spark, path)
    collection.save(_keyworded(spark, sf_dir), path)
    key = T.StructField("doc_id", T.LongType())
    back = collection.read(spark, path, SEARCH_CATEGORY, schema=collection.collection_schema(key))
    return _hits(back)


def q_saved_rows(spark, sf_dir):
    """AG9: the row count that saving the keyworded pages reports."""
    path = scratch_dir(spark, "saved")
    return collection.save(_keyworded(spark, sf_dir), path)


def q_union_collections(spark, sf_dir):
    """SO1/IO6/IO11: three writers into one collection, read back whole."""
    path = scratch_dir(spark, "union")
    collection.initialize(spark, path)
    pages = _keyworded(spark, sf_dir)
    collection.save(pages.drop("doc_id"), path)
    model = _model(spark, sf_dir, gathered=False)
    # On the key-bucketed page table both the per-page sums and the join back to the
    # texts reuse the bucket partitioning: no page content is shuffled.
    bucketed = standins.bucketed_pages(spark, sf_dir)
    labelled = model.transform(bucketed)
    texts = bucketed.select("doc_id", "content")
    classified = texts.join(labelled, "doc_id").withColumn("millis", F.lit(1704067200000) + F.col("doc_id"))
    collection.append_classified(classified.drop("doc_id"), path, timestamp="millis")
    collection.save(corpus.parse_lines(_written_corpus(spark, sf_dir)).select("category", "content"), path)
    back = collection.read(spark, path)
    return back.select("category", "content",
                       F.array_join("keywords", ",").alias("keywords"),
                       F.unix_millis("timestamp").alias("millis"))


def q_classified_now(spark, sf_dir):
    """IO6/DT3: classified documents are stamped with the time of the write."""
    path = scratch_dir(spark, "now")
    docs = standins.pages(spark, sf_dir).select("doc_id", "content", "category")
    collection.append_classified(docs, path)
    back = collection.read(spark, path, schema=collection.collection_schema(T.StructField("doc_id", T.LongType())))
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("timestamp")
    return back.select("doc_id", "category", age.between(0, 3600).alias("just_now"))


def _event_times(spark, sf_dir) -> DataFrame:
    """Events as documents whose timestamp is text: every seventh is no time, every eleventh is missing."""
    e = standins.table(spark, sf_dir, "events")
    iso = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("late on "), iso)).when(F.col("event_id") % 11 != 0, iso)
    return e.select(F.col("event_id").cast("string").alias("url"), text.alias("timestamp"), F.lit("events").alias("category"))


def q_typed_ingestion(spark, sf_dir):
    """SO1: text timestamps are parsed; rows with a text that is no time are kept apart."""
    path = scratch_dir(spark, "typed")
    collection.save(_event_times(spark, sf_dir), path)
    good = collection.read(spark, path).select("url", F.unix_seconds("timestamp").alias("seconds"), F.lit(None).cast("string").alias("rejected"))
    bad = collection.rejects(spark, path).select(F.get_json_object("row", "$.url").alias("url"), F.lit(None).cast("long").alias("seconds"),
                                                 "field")
    return good.unionByName(bad.withColumnRenamed("field", "rejected"))


def q_retried_save(spark, sf_dir):
    """IO4/IO11: one save done twice under its write id, another beside it, then all compacted."""
    path = scratch_dir(spark, "retried")
    pages = standins.pages(spark, sf_dir)
    collection.save(pages, path, write_id="pages-1")
    again = collection.save(pages, path, write_id="pages-1").first()["rows"]
    collection.save(pages.where("category = 'src3'"), path, write_id="pages-2")
    collection.compact(spark, path)
    return collection.read(spark, path).groupBy("category").agg(F.count("*").alias("pages")).withColumn("reported", F.lit(again).cast("long"))

# --- model ------------------------------------------------------------------------------

def q_word2vec_vocab(spark, sf_dir):
    """ML1/FI7: fit Word2Vec on the page lines, return the learned vocabulary."""
    lines = word2vec.text_lines(standins.text_pages(spark, sf_dir))
    sents = word2vec.sentences(lines)
    model = word2vec.train(sents, num_partitions=spark.sparkContext.defaultParallelism)
    return word2vec.vocabulary(model).select("token")


def q_w2v_classify(spark, sf_dir):
    """ML1 -> IO12 -> ML2: train word vectors on the labelled corpus file (label tokens
    included, as the reference trains on raw lines), save the model, load it back, and
    classify every page with the learned vectors.  Training is iterative, so the columns are
    what any right model has: known tokens, vector length, a category of the dictionary, and
    loaded vectors equal to the saved ones."""
    lines = _written_corpus(spark, sf_dir)
    path = scratch_dir(spark, "w2v-model")
    saved = word2vec.vocabulary(word2vec.load_or_train(
        spark, path, lambda: word2vec.sentences(lines), num_partitions=spark.sparkContext.defaultParallelism))
    learned = word2vec.vocabulary(word2vec.load_or_train(spark, path, None))  # loads the saved model
    equal = saved.exceptAll(learned).isEmpty() and learned.exceptAll(saved).isEmpty()
    cats = standins.categories(standins.vocabulary(spark, sf_dir))
    model = CategoryModel(learned, cats)
    return model.transform(standins.text_pages(spark, sf_dir), with_known=True).select(
        "doc_id", "n_known", F.lit(model.sizes.dim == 100).alias("dimension_100"),
        F.col("category").isin(*DEFAULT_CATEGORY_ORDER, UNKNOWN_CATEGORY).alias("in_dictionary"),
        F.lit(equal).alias("reloaded_equal"))


def q_classify_many(spark, sf_dir):
    """AG7/JN2 with many categories: every vocabulary word is one of its own; the page's is the nearest."""
    vocab = standins.vocabulary(spark, sf_dir)
    cats = vocab.select(F.col("token").alias("category"), F.lit(0).alias("ord"), F.col("token").alias("keyword"))
    return CategoryModel(vocab, cats).transform(standins.text_pages(spark, sf_dir))


def q_classify_default(spark, sf_dir):
    """ML3: pages classified by the built-in dictionary."""
    return CategoryModel(standins.vocabulary(spark, sf_dir)).transform(standins.text_pages(spark, sf_dir))


# --- streaming --------------------------------------------------------------------------

def _message_source(spark, sf_dir) -> str:
    """Page messages (JSON lines) written once from the page table: the stand-in for a
    topic.  Every stream query starts from a fresh checkpoint, so it reads them all."""
    return standins.stored(spark, sf_dir, "messages", lambda: _write_messages(spark, sf_dir))


def _page_messages(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.to_json(F.struct("doc_id", F.concat(F.lit("http://pages.test/"), "doc_id").alias("url"), "content",
                           F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("timestamp")))
        .alias("value"))


def _write_messages(spark, sf_dir) -> str:
    src = scratch_dir(spark, "stream-src")
    msgs = _page_messages(standins.pages(spark, sf_dir))
    # Two micro-batches of `parallelism` files each (a topic's partitions play this role).
    msgs.repartition(2 * spark.sparkContext.defaultParallelism).write.mode("overwrite").text(src)
    return src


def _per_trigger(spark) -> dict:
    return {"maxFilesPerTrigger": str(spark.sparkContext.defaultParallelism)}


STREAM_DDL = "doc_id bigint, url string, content string, timestamp timestamp"


def q_stream_keywords(spark, sf_dir):
    """ST1 stateless: keyword extraction as a plain streaming projection into a file sink."""
    src = _message_source(spark, sf_dir)
    sink, rejects, ckpt = (scratch_dir(spark, n) for n in ("kw-out", "kw-rejects", "kw-ckpt"))
    raw = read_stream(spark, "text", _per_trigger(spark), path=src)
    for q in enrich.start_stateless(raw, sink, ckpt, rejects, lambda d: keywords.extract_keywords(d, "doc_id"),
                                    schema_ddl=STREAM_DDL):
        q.awaitTermination()
    return spark.read.parquet(sink).select("doc_id", _joined("keywords"))


def q_stream_classify(spark, sf_dir):
    """ST1-ST3/U1: page messages through the stateless stream, classified per micro-batch."""
    model = _model(spark, sf_dir)
    src = _message_source(spark, sf_dir)
    sink, rejects, ckpt = (scratch_dir(spark, n) for n in ("stream-out", "stream-rejects", "stream-ckpt"))
    raw = read_stream(spark, "text", _per_trigger(spark), path=src)
    q = enrich.start(raw, sink, ckpt, rejects,
                     batch_fn=lambda b: model.transform(b, key="doc_id", carry=["url", "timestamp"]),
                     schema_ddl=STREAM_DDL)
    q.awaitTermination()
    return spark.read.parquet(sink).select("doc_id", "category")


def q_stream_classify_stateless(spark, sf_dir):
    """ST1/U1: the classifier as a plain streaming projection into a file sink (no foreachBatch)."""
    model = _model(spark, sf_dir)
    src = _message_source(spark, sf_dir)
    sink, rejects, ckpt = (scratch_dir(spark, n) for n in ("plain-out", "plain-rejects", "plain-ckpt"))
    raw = read_stream(spark, "text", _per_trigger(spark), path=src)
    for q in enrich.start_stateless(raw, sink, ckpt, rejects, lambda d: model.transform(d, key="doc_id", carry=["url"]),
                                    schema_ddl=STREAM_DDL):
        q.awaitTermination()
    return spark.read.parquet(sink).select("doc_id", "category")


def q_stream_content_fn(spark, sf_dir):
    """PR4/U1: every message with a function (e becomes E) applied to its content; url and
    timestamp (as seconds) stay."""
    src = _message_source(spark, sf_dir)
    sink, rejects, ckpt = (scratch_dir(spark, n) for n in ("fn-out", "fn-rejects", "fn-ckpt"))
    raw = read_stream(spark, "text", _per_trigger(spark), path=src)
    enrich.start(raw, sink, ckpt, rejects, content_fn=lambda c: F.translate(c, "e", "E"), schema_ddl=STREAM_DDL).awaitTermination()
    return spark.read.parquet(sink).select("url", "content", F.unix_seconds("timestamp").alias("seconds"))


def _publish(spark, sf_dir, topic: str, third: int) -> None:
    """A third of the pages as messages of the topic."""
    message_log.register(spark)
    msgs = _page_messages(standins.pages(spark, sf_dir).where(F.pmod("doc_id", F.lit(3)) == third))
    msgs.write.format("message_log").mode("append").option("path", topic).save()


def q_stream_from_latest(spark, sf_dir):
    """IO1/ST1: a stream that starts at the latest offset skips the messages before it; stopped and
    started again it goes on where it was."""
    topic, sink, rejects, ckpt = (scratch_dir(spark, n) for n in ("log-topic", "log-out", "log-rejects", "log-ckpt"))

    def go():
        raw = read_stream(spark, "message_log", message_log_options(topic, "latest", group="keywords"))
        for q in enrich.start_stateless(raw, sink, ckpt, rejects, lambda d: keywords.extract_keywords(d, "doc_id"),
                                        schema_ddl=STREAM_DDL):
            q.awaitTermination()
    for third in range(3):
        _publish(spark, sf_dir, topic, third)
        go()
    return spark.read.parquet(sink).select("doc_id", _joined("keywords"))


def q_stream_message_sink(spark, sf_dir):
    """IO2/ST2: classified messages into a topic; the last batch is run again after a failure (its commit
    is lost), and each message is in the topic once."""
    model = _model(spark, sf_dir)
    topic, results, rejects, ckpt = (scratch_dir(spark, n) for n in ("in-topic", "out-topic", "out-rejects", "out-ckpt"))
    _publish(spark, sf_dir, topic, 0)

    def go():
        raw = read_stream(spark, "message_log", message_log_options(topic, "earliest"))
        enrich.start(raw, results, ckpt, rejects, schema_ddl=STREAM_DDL, sink_format="message_log",
                     batch_fn=lambda b: model.transform(b, key="doc_id", carry=["url", "timestamp"])).awaitTermination()
    go()
    _publish(spark, sf_dir, topic, 1)
    go()
    paths.delete(spark, f"{ckpt}/commits/{max(int(n) for n in paths.names(spark, f'{ckpt}/commits') if n.isdigit())}")
    go()
    back = spark.read.format("message_log").option("path", results).load().selectExpr("CAST(value AS STRING) AS json")
    return back.select(F.from_json("json", "doc_id bigint, url string, category string").alias("m")).select("m.*")


def q_classify_by_url(spark, sf_dir):
    """ML2 where keys repeat and are missing: the url is one of 50, or NULL for every tenth
    page; one row per page comes back."""
    url = F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("u"), (F.col("doc_id") % 50).cast("string")))
    pages = standins.text_pages(spark, sf_dir).withColumn("url", url)
    return _model(spark, sf_dir).transform(pages, key="url")


QUERIES: dict[str, Query] = {
    "stream_content_fn": q_stream_content_fn,
    "stream_classify_stateless": q_stream_classify_stateless,
    "stream_from_latest": q_stream_from_latest,
    "stream_message_sink": q_stream_message_sink,
    "classify_by_url": q_classify_by_url,
    "tokenize": q_tokenize,
    "keyword_counts": q_keyword_counts,
    "keywords_top10": q_keywords_top10,
    "keywords_page": q_keywords_page,
    "keywords_by_tag": q_keywords_by_tag,
    "keywords_by_large_lexicon": q_keywords_by_large_lexicon,
    "by_category": q_by_category,
    "by_keywords": q_by_keywords,
    "search_both": q_search_both,
    "search_indexed": q_search_indexed,
    "keyword_postings": q_keyword_postings,
    "keywords_by_context": q_keywords_by_context,
    "search_keywords_only": q_search_keywords_only,
    "search_total": q_search_total,
    "pages_per_category": q_pages_per_category,
    "pages_per_category_top10": q_pages_per_category_top10,
    "top_keywords_per_category": q_top_keywords_per_category,
    "pages_per_hour": q_pages_per_hour,
    "pages_per_day": q_pages_per_day,
    "rollup_per_category": q_rollup_per_category,
    "rollup_top_keywords": q_rollup_top_keywords,
    "rollup_per_hour": q_rollup_per_hour,
    "rollup_per_day": q_rollup_per_day,
    "json_fields": q_json_fields,
    "doc_vector_norm": q_doc_vector_norm,
    "doc_vector_norm_joined": q_doc_vector_norm_joined,
    "category_centroid": q_category_centroid,
    "cosine_per_category": q_cosine_per_category,
    "classify": q_classify,
    "classify_bucketed": q_classify_bucketed,
    "classify_default": q_classify_default,
    "classify_many": q_classify_many,
    "label_lines": q_label_lines,
    "label_parse": q_label_parse,
    "label_parse_all": q_label_parse_all,
    "dropped_lines": q_dropped_lines,
    "saved_rows": q_saved_rows,
    "first_n": q_first_n,
    "collection_roundtrip": q_collection_roundtrip,
    "union_collections": q_union_collections,
    "classified_now": q_classified_now,
    "typed_ingestion": q_typed_ingestion,
    "retried_save": q_retried_save,
    "word2vec_vocab": q_word2vec_vocab,
    "stream_classify": q_stream_classify,
    "stream_keywords": q_stream_keywords,
    "w2v_classify": q_w2v_classify,
}
