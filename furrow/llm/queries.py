"""One named query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from furrow.llm import collocations, fingerprints, idfiles, licenses, neardup, negatives, neighbours, packing, pieces, repeats, secrets, shards, toxicity
from furrow.llm.common import read

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secrets.scan(docs, common=secrets.corpus_words(docs))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(read(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, where=toxicity.remainder() != 0)
    return toxicity.score(docs, model).withColumn("held_out", toxicity.remainder() == 0)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edit(read(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, radius=2, seed=42)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents"), PIECE_MODEL)


def op10_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.write_and_read(read(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabel=moved)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scans, op2_sharding, op3_nearest_neighbours, op4_packing, op5_toxicity, op6_fingerprints,
        op7_simhash_near_dedup, op8_license_scans, op9_sentencepiece, op10_token_id_output, op11_repeats, op12_hard_negatives,
        op13_collocations,
    )
}

ORACLE: dict[str, str] = {
    "op11_repeats": """
with docs as (
    select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), strings as (
    select doc_id, s, substr(h, 2 * s + 1, 200) as string
    from (select doc_id, h, unnest(range(0, len(h) // 2 - 99)) as s from docs where len(h) >= 200)
), late as (
    select doc_id, s from strings qualify row_number() over (partition by string order by doc_id, s) > 1
), edges as (
    select doc_id, s, coalesce(s - lag(s) over (partition by doc_id order by s) > 100, true) as fresh from late
), numbered as (
    select doc_id, s, sum(fresh::int) over (partition by doc_id order by s) as span from edges
), spans as (
    select doc_id, span, min(s) as a, max(s) + 100 as b from numbered group by doc_id, span
), gaps as (
    select doc_id, span, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans
), kept as (
    select doc_id, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last,
           string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as head, any_value(h) as h
    from gaps join docs using (doc_id) group by doc_id
)
select d.doc_id, (len(d.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(case when k.doc_id is null then d.h else head || substr(k.h, 2 * last + 1) end)) as kept_sha256
from docs d left join kept k using (doc_id)
""",
    "op12_hard_negatives": """
with given as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
    from given a, given b
    where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::integer as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
""",
    "op13_collocations": """
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), worded as (
    select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces
), grams as (
    select lang, phrase, len(string_split(phrase, ' ')) as size, count(*) as n
    from (
        select lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i])) as phrase from worded
        union all
        select lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from worded
        union all
        select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from worded
    )
    group by lang, phrase
), totals as (
    select lang, sum(n)::bigint as n from grams where size = 1 group by lang
), found as (
    select *, string_split(phrase, ' ') as w from grams where size > 1 and n >= 10
), cuts as (
    select lang, phrase, n as a, 1 as k, w[1] as head, array_to_string(w[2:], ' ') as tail from found
    union all
    select lang, phrase, n, 2, w[1] || ' ' || w[2], w[3] from found where size = 3
), scored as (
    select c.lang, c.phrase, c.a, x.n as l, y.n as r, (1000000::hugeint * c.a * c.a // (x.n::hugeint * y.n))::bigint as score
    from cuts c join grams x on x.lang = c.lang and x.phrase = c.head join grams y on y.lang = c.lang and y.phrase = c.tail
    qualify row_number() over (partition by c.lang, c.phrase order by score, k) = 1
), inside as (
    select lang, phrase, max(n) as longer
    from (select lang, w[1] || ' ' || w[2] as phrase, n from found where size = 3
          union all select lang, w[2] || ' ' || w[3], n from found where size = 3)
    group by lang, phrase
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank,
       phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score
from scored left join inside using (lang, phrase) join totals using (lang)
where longer is null or 100 * longer < 50 * a
qualify rank <= 2000
""",
}
