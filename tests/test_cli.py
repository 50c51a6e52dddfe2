from pyspark.sql import functions as F

from adlens import cli
from adlens.session import scratch_dir

SF = "/root/testdata/sf0.001"


def test_cli_index_search_report_classify(spark):
    pages_path = scratch_dir(spark, "cli-pages")
    (spark.read.parquet(f"{SF}/documents.parquet")
     .select(F.col("doc_id"), F.concat(F.lit("u"), F.col("doc_id")).alias("url"), F.col("text").alias("content"),
             F.col("source").alias("category"), F.col("lang").alias("author"))
     .write.parquet(pages_path))
    coll = scratch_dir(spark, "cli-coll")
    cli.main(["index", "--pages", pages_path, "--collection", coll, "--key", "doc_id"], spark)
    assert spark.read.parquet(coll).count() == 200
    out = scratch_dir(spark, "cli-search")
    cli.main(["search", "--collection", coll, "--keywords", "der,les", "--category", "src3",
              "--key", "doc_id", "--key-type", "bigint", "--output", out], spark)
    hits = spark.read.parquet(out)
    assert hits.filter(F.col("category") != "src3").count() == 0
    cat_out = scratch_dir(spark, "cli-bycat")
    cli.main(["by-category", "--collection", coll, "--category", "src3", "--key", "doc_id",
              "--key-type", "bigint", "--output", cat_out], spark)
    bycat = spark.read.parquet(cat_out)
    assert bycat.count() == 10 and "content" not in bycat.columns
    rep = scratch_dir(spark, "cli-report")
    cli.main(["report", "--collection", coll, "--kind", "per-category", "--output", rep], spark)
    assert spark.read.parquet(rep).count() == 20
    vec = scratch_dir(spark, "cli-vec")
    spark.createDataFrame([("money", [1.0, 0.0]), ("hotel", [0.0, 1.0])], "token string, vector array<float>") \
        .write.parquet(vec)
    cls = scratch_dir(spark, "cli-cls")
    cli.main(["classify", "--pages", pages_path, "--vectors", vec, "--key", "doc_id", "--output", cls], spark)
    assert spark.read.parquet(cls).count() == 200


def test_cli_stream_once_with_file_source(spark):
    import json
    import os
    src = scratch_dir(spark, "cli-stream-src")
    local = src.replace("file:", "", 1)
    os.makedirs(local, exist_ok=True)
    with open(os.path.join(local, "m.json"), "w") as f:
        f.write("\n".join([json.dumps({"url": "u1", "content": "bank money bank"}),
                           json.dumps({"url": "u2", "content": "hotel travel"}), "nope"]) + "\n")
    vec = scratch_dir(spark, "cli-stream-vec")
    spark.createDataFrame([("bank", [1.0, 0.1]), ("money", [0.9, 0.0]), ("hotel", [0.0, 1.0])],
                          "token string, vector array<float>").write.parquet(vec)
    out, rej, ck = (scratch_dir(spark, n) for n in ("cli-s-out", "cli-s-rej", "cli-s-ck"))
    cli.main(["stream", "--vectors", vec, "--format", "text", "--source", src, "--output", out,
              "--rejects", rej, "--checkpoint", ck, "--once"], spark)
    got = {r["url"]: r["category"] for r in spark.read.parquet(out).collect()}
    assert got == {"u1": "finance", "u2": "travel"}
    assert [r["json"] for r in spark.read.parquet(rej).collect()] == ["nope"]


def test_cli_corpus_train_and_reports(spark):
    ex = scratch_dir(spark, "cli-ex")
    (spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
     .select((F.col("quality") * 2 + F.col("toxic")).alias("label"), "text").write.parquet(ex))
    text_out = scratch_dir(spark, "cli-corpus")
    cli.main(["corpus", "--examples", ex, "--output", text_out], spark)
    lines = spark.read.text(text_out)
    assert lines.filter(F.col("value").startswith("__label__")).count() > 0
    model, vec = scratch_dir(spark, "cli-model"), scratch_dir(spark, "cli-vectors")
    cli.main(["train", "--corpus", text_out, "--model", model, "--vectors", vec, "--partitions", "2"], spark)
    vocab = spark.read.parquet(vec)
    assert vocab.count() > 0 and set(vocab.columns) == {"token", "vector"}
    pages_path = scratch_dir(spark, "cli-pages2")
    (spark.read.parquet(f"{SF}/documents.parquet")
     .select("doc_id", F.col("text").alias("content"), F.col("source").alias("category"))
     .write.parquet(pages_path))
    coll = scratch_dir(spark, "cli-coll2")
    cli.main(["index", "--pages", pages_path, "--collection", coll, "--key", "doc_id"], spark)
    top = scratch_dir(spark, "cli-top")
    cli.main(["report", "--collection", coll, "--kind", "top-keywords", "--output", top], spark)
    assert spark.read.parquet(top).count() == 20
    per = scratch_dir(spark, "cli-per")
    cli.main(["report", "--collection", coll, "--kind", "per-period", "--period", "day", "--output", per], spark)
    assert spark.read.parquet(per).count() == 0  # keyworded pages carry no timestamp
