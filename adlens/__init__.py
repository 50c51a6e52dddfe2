"""adlens: page keyword and ad-category analytics expressed as Spark DataFrame plans.

Layout
------
functions/   Column-expression building blocks (tokenizers, cosine, date buckets, ...)
operators/   DataFrame -> DataFrame operators (keywords, vectors, classify, search, analytics)
sources/     readers/writers (page collection, labelled text corpus, stream source/sink)
plans/       the query catalogue used by ``__spark_entry__`` and ``bench.py``
streaming/   the stateless enrich/classify stream
"""

from adlens.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
