"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import codebooks, decontamination, line_dedup, near_dup, packing, resampling, sharding, simhash, token_counts, token_files, toxicity, warc
from siltstone.llm.quality import quality
from siltstone.llm.storage import new_folder, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; the trusted target is what labels.quality marks 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality(docs, trusted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids: where every piece lies."""
    docs = table(spark, sf_dir, "documents")
    pieces = packing.tokenized_pieces(docs, vocabulary("word_bpe_49k.json"), end_id=1)
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents, the same batch again, copies taken out, padded texts revised."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    versions = {"byte_bpe_50k": vocabulary("byte_bpe_50k.json"), "word_bpe_49k": vocabulary("word_bpe_49k.json")}
    trimmed = F.btrim("text", F.lit(" \t\r\n"))
    padded = docs.withColumn("trimmed", F.when(trimmed != F.col("text"), trimmed))
    counted = written(token_counts.count_tokens(padded, versions, revised="trimmed"), "token-counts")
    rollup = token_counts.Rollup(spark, new_folder(spark, "token-rollup"))
    rollup.commit("load", token_counts.inserts(counted))
    rollup.commit("load", token_counts.inserts(counted))
    kept = token_counts.first_of_copies(counted)
    rollup.commit("copies", token_counts.revisions(counted, kept))
    rollup.commit("trim", token_counts.revisions(kept, kept.withColumn("n_tokens", F.col("n_revised"))))
    return rollup.totals()


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives, then what the archives say of every record."""
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), least_bytes=0))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts are at most one apart."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    dealt = sharding.shuffle_into_shards(rows, ["doc_id", "size", "text_crc32"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the passages that an earlier one holds."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as compressed ids, then what the files say of each."""
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(manifest)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage similar to a benchmark item, and which."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighted towards the benchmark's texts, and the ranks of the 5 % that are drawn."""
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as codes of 16 codebooks of 64 entries, trained on all of them."""
    return codebooks.coded(table(spark, sf_dir, "embeddings")).drop("label")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the component that links of 4 bits at most put it in."""
    return simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_sharding": op6_sharding,
    "op7_line_dedup": op7_line_dedup,
    "op8_near_dup": op8_near_dup,
    "op9_token_files": op9_token_files,
    "op10_decontamination": op10_decontamination,
    "op11_resampling": op11_resampling,
    "op12_vector_codes": op12_vector_codes,
    "op13_simhash": op13_simhash,
}



def _assigned(books: str) -> str:
    """SQL: the nearest entry of every part, the lowest of equals, and its squared distance."""
    return f"""select rn, p, any_value(x) as x, arg_min(e, d * 64 + e) as e, min(d) as d from (
        select a.rn, a.p, a.x, b.e, list_inner_product(a.x, a.x) - 2 * list_inner_product(a.x, b.x) + list_inner_product(b.x, b.x) as d
        from parts a join {books} b on a.p = b.p) group by rn, p"""


def _moved(books: str, assigned: str) -> str:
    """SQL: entries at the floor of the mean of their parts; unused ones stay."""
    return f"""select b.p, b.e, coalesce(m.x, b.x) as x from {books} b left join (
        select p, e, list(floor(s / n) order by i) as x from (
            select p, e, i, sum(x[i]) as s, count(*) as n from (select p, e, x, unnest(generate_series(1, len(x))) as i from {assigned}) group by p, e, i
        ) group by p, e) m on b.p = m.p and b.e = m.e"""


OP12_SQL = f"""
with kept as (
    select vec_id, label, row_number() over (order by vec_id) as rn, list_transform(embedding, lambda c: floor(256 * c::double)) as v
    from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), parts as (
    select rn, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) as x from kept, (select unnest(range(16)) as p)
), book0 as (select p, rn - 1 as e, x from parts where rn <= 64),
near0 as materialized ({_assigned("book0")}), book1 as materialized ({_moved("book0", "near0")}),
near1 as materialized ({_assigned("book1")}), book2 as materialized ({_moved("book1", "near1")}),
near2 as materialized ({_assigned("book2")}),
sums as (select rn, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from near2 group by rn),
digest as (
    select sha256(string_agg(x[i]::bigint::varchar, ',' order by p, e, i)) as h
    from (select p, e, x, unnest(generate_series(1, len(x))) as i from book2)
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, (select h from digest) as codebooks_sha256
from kept join sums using (rn)
"""

#: The others cannot be written in SQL: they hash, tokenise, train, draw or write files. Tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op12_vector_codes": OP12_SQL}
