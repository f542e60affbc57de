"""Queries p2, p4, p6, p7 and p8: the text operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import written
from . import alignment, bpe, langid, packing, repetition


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark, d):
    """books_texts with one row per text and the language that its locale names."""
    codes = [(r.code, r.code3) for r in _t(spark, d, "locales").select("code", "code3").collect()]  # six rows
    one = _t(spark, d, "books_texts").where("text_ID is not null").groupBy("text_ID").agg(F.min(F.struct("ID", "locale", "descr")).alias("r")).select("text_ID", "r.*")
    return one.withColumn("label", langid.locale_code(F.col("locale"), codes))


def _spread(df, key):
    """Small partitions, however few bytes there are: what follows takes much CPU a row."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), key)


def _books(spark, d):
    return _t(spark, d, "books").where("ID is not null").groupBy("ID").agg(F.max_by("descr", F.struct("arrived_at", "descr")).alias("source"))


def _dictionaries(spark, d):
    return langid.fit(_texts(spark, d), "descr", "label", more=_t(spark, d, "books"))


def p2_found(spark, d):
    texts = _texts(spark, d)
    segs = langid.segments(_spread(texts.select("text_ID", "descr"), "text_ID"), "text_ID", "descr", _dictionaries(spark, d))
    segs = written(segs.select("text_ID", "seg_no", "lang", "confidence"), "segments")
    return langid.mislabelled(texts, "text_ID", "label", segs).where("lang is not null").select("text_ID", "seg_no", "lang")


def p2_segments(spark, d):
    return langid.segments(_spread(_texts(spark, d).select("text_ID", "descr"), "text_ID"), "text_ID", "descr", _dictionaries(spark, d)).drop("text")


def p4_found(spark, d):
    joined = _texts(spark, d).join(_books(spark, d), "ID").select("text_ID", "source", F.col("descr").alias("target")).where("source is not null and target is not null")
    texts = written(alignment.prepared(_spread(joined, "text_ID"), "text_ID", _dictionaries(spark, d)), "prepared")
    found = alignment.align_all(_spread(texts, "text_ID"), "text_ID")
    return found.select("text_ID", F.col("source_sent").alias("book_sent"), F.col("target_sent").alias("text_sent"))


def p6_ids(spark, d):
    return bpe.encode_texts(_t(spark, d, "documents"), "doc_id", "text", bpe.vocabulary("byte_bpe_50k"))


def p6_round_trip(spark, d):
    """Texts that come back changed from encoding and decoding: none but null ones."""
    docs, path = _t(spark, d, "documents").select("doc_id", "text"), bpe.vocabulary("byte_bpe_50k")
    back = bpe.decode_ids(bpe.encode_texts(docs, "doc_id", "text", path), "doc_id", path).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").where(~F.col("text").eqNullSafe(F.col("back"))).select("doc_id")


def p7_packing(spark, d):
    return packing.pack_all(_t(spark, d, "documents"), _t(spark, d, "capacities"))


def p7_use(spark, d):
    caps = _t(spark, d, "capacities")
    return packing.use(packing.pack_all(_t(spark, d, "documents"), caps), caps)


def p7_mix(spark, d):
    """The largest distance of a source's share from its target in 64 containers in a row, by kind; the last windows of a shard aside, where sources run out."""
    docs, caps = _t(spark, d, "documents"), _t(spark, d, "capacities")
    m = packing.mixture(packing.pack_all(docs, caps), docs)
    ends = m.groupBy("kind", "shard").agg(F.max("window").alias("last"))
    inner = m.join(ends, ["kind", "shard"]).where(F.col("window") < F.col("last") - packing.WIDE)
    return inner.groupBy("kind").agg(F.max(F.abs(F.col("share") - F.col("target"))).alias("off"), F.count_distinct("shard", "window").alias("windows"))


def p7_check(spark, d):
    docs, caps = _t(spark, d, "documents"), _t(spark, d, "capacities")
    sizes = None
    for name in sorted({r.tokenizer for r in caps.select("tokenizer").distinct().collect()}):  # a few names
        kinds = caps.where(F.col("tokenizer") == name).select("kind").distinct()
        own = packing.token_counts(docs, "doc_id", "text", "source", bpe.vocabulary(name)).select("id", "tokens").crossJoin(kinds)  # a row per capacity
        sizes = own if sizes is None else sizes.unionByName(own)
    return packing.faults(packing.pack_all(docs, caps), sizes, caps)


def p8_found(spark, d):
    return repetition.repetition(_t(spark, d, "documents"), "doc_id", "text").where("band = 'repetitive' and share >= 0.5").select("doc_id")


def p8_share(spark, d):
    return repetition.repetition(_t(spark, d, "documents"), "doc_id", "text").select("doc_id", "n_words", "share")


def p8_bands(spark, d):
    return repetition.repetition(_t(spark, d, "documents"), "doc_id", "text").select("doc_id", "n_words", "ratio", "chunk_ratio", "raw_ratio", "band", "share")


QUERIES = {f.__name__: f for f in (p2_found, p2_segments, p4_found, p6_ids, p6_round_trip, p7_packing, p7_use, p7_mix, p7_check, p8_found, p8_share, p8_bands)}

# words lower-cased, passages of six by position, those that occur four times, and the positions they cover
_COVER = r"""w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from documents),
    g as (select doc_id, unnest(range(1, len(ws) - 4)) as pos, ws from w where len(ws) >= 6),
    k as (select doc_id, pos, ws[pos:pos + 5] as gram from g),
    many as (select doc_id, gram from k group by all having count(*) >= 4),
    cover as (select distinct k.doc_id, unnest(range(k.pos, k.pos + 6)) as at_word from k join many m on m.doc_id = k.doc_id and m.gram = k.gram),
    n as (select doc_id, count(*) as covered from cover group by doc_id)"""

ORACLE = {
    "p6_round_trip": "select doc_id from documents where text is null",
    "p7_check": "select '' as kind, '' as what, '' as id where false",
    "p8_found": f"with {_COVER} select w.doc_id from w join n on n.doc_id = w.doc_id where covered * 2 >= len(ws)",
    "p8_share": f"with {_COVER} select w.doc_id, coalesce(len(ws), 0) as n_words, coalesce(covered / len(ws), 0.0) as share from w left join n on n.doc_id = w.doc_id",
}
