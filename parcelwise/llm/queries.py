"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import (
    bpe,
    collocations,
    embedding,
    lexical,
    line_dedup,
    maxent,
    mixing,
    quality_net,
    quality_rules,
    repeats,
    simhash,
    toxicity,
    warc,
)
from parcelwise.llm.shared import table
from parcelwise.session import new_place

# Target shares: the large crawl is held at a quarter, the curated sources share the rest.
WEIGHTS = {"src0": 0.25} | {f"src{i}": 0.75 / 19 for i in range(1, 20)}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated lines: five words, 3 bits, edit similarity 0.8."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs).select("doc_id", "_lines.n_lines", "_lines.n_removed", "text")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 400-byte strings that also start elsewhere, as digests."""
    found = repeats.without_repeats(table(spark, sf_dir, "documents"), length=400)
    return found.select(
        "doc_id",
        "n_bytes",
        F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, at most 3 differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=3)


def op4_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector: cosine 0.95, 16 sorted passes."""
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and position of every document in the mix of sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    hashed = docs.select("doc_id", F.xxhash64("text").cast("string").alias("text"), "source")
    return mixing.scheduled(hashed, WEIGHTS).select("doc_id", "source", "_mix.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality_rules.judged(docs, table(spark, sf_dir, "labels"))
    wanted = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"
    return judged.select("doc_id", *[f"_quality.{c}" for c in wanted.split()])


def _held_out(parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.learned(docs, labels, ~_held_out(5, 0))
    return toxicity.scored(docs, model).select(
        "doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    path = warc.write(table(spark, sf_dir, "pages"), new_place(spark, "warc"))
    found = warc.read(spark, path, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, as digests."""
    return bpe.token_digests(bpe.encoded(table(spark, sf_dir, "documents"), TOKENIZER))


# Base32 by hand: five bytes of the digest are ten hex digits and eight letters.
OP8 = """
with p as (
    select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages
), d as (
    select html, max(page_id) as original, count(*) as n from p group by html
)
select p.page_id,
       strlen(p.html)::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(p.sha, (i // 8) * 10 + 1, 10))::bigint >> (35 - 5 * (i % 8))::int) & 31)::int + 1, 1)), '')
           as payload_digest,
       case when n = 1 or p.page_id = original then 'response' else 'revisit' end as record_type,
       case when n = 1 or p.page_id = original then null else original end as refers_to
from p join d using (html)
"""


def op10_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality_net.scored(docs, labels, ~_held_out(4, 2)).select(
        "doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of two and three words of each language."""
    found = collocations.collocations(table(spark, sf_dir, "documents"), (2, 3), least=10, subsumed_percent=50, top=2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11 = """
with pieces as (
    select coalesce(lang, 'und') as lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
    from documents
), worded as (
    select lang, row_number() over () as piece_id, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from pieces
), placed as (
    select lang, piece_id, unnest(ws) as w1, unnest(range(len(ws))) as i from worded
), runs as (
    select lang, w1, lead(w1, 1) over along as w2, lead(w1, 2) over along as w3
    from placed window along as (partition by piece_id order by i)
), f as materialized (
    select lang, k, case k when 1 then w1 when 2 then w1 || ' ' || w2 else w1 || ' ' || w2 || ' ' || w3 end as phrase,
           count(*) as n
    from runs, (values (1), (2), (3)) as sizes(k)
    where k = 1 or (k = 2 and w2 is not null) or (k = 3 and w3 is not null)
    group by all
), totals as (
    select lang, sum(n)::bigint as n from f where k = 1 group by lang
), candidates as (
    select *, string_split(phrase, ' ') as ws from f where k >= 2 and n >= 10
), inner_parts as (
    select lang, n, array_to_string(ws[1:2], ' ') as phrase from candidates where k = 3
    union all
    select lang, n, array_to_string(ws[2:3], ' ') from candidates where k = 3
), longer as (
    select lang, phrase, max(n) as n from inner_parts group by all
), parts as (
    select lang, phrase, n as a, unnest(range(1, k)) as j, ws from candidates
), sides as materialized (
    select lang, phrase, a, j, array_to_string(ws[1:j], ' ') as first, array_to_string(ws[j + 1:], ' ') as rest from parts
), cuts as (
    select s.lang, s.phrase, s.a, s.j, x.n as l, y.n as r,
           ((1000000::hugeint * s.a * s.a) // (x.n::hugeint * y.n))::bigint as score
    from sides s
    join f x on x.lang = s.lang and x.phrase = s.first
    join f y on y.lang = s.lang and y.phrase = s.rest
), best as (
    select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1
), ranked as (
    select b.*, row_number() over (partition by b.lang order by b.score desc, b.a desc, b.phrase) as rank
    from best b left join longer g on g.lang = b.lang and g.phrase = b.phrase
    where coalesce(100 * g.n < 50 * b.a, true)
)
select lang, rank, phrase, a, l, r, t.n as n, score from ranked join totals t using (lang) where rank <= 2000
"""


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


OP12 = """
with texts as (
    select true as is_doc, row_number() over () as row_id, doc_id as id, text from documents
    union all
    select false, row_number() over (), item_id, text from benchmark
), termed as (
    select is_doc, row_id, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ts
    from texts
), occurrences as (
    select is_doc, row_id, id, len(ts) as n, unnest(ts) as term from termed
), tf as materialized (
    select is_doc, row_id, id, n, term, count(*) as tf from occurrences group by all
), sizes as (
    select count(*) as docs, sum(len(ts))::bigint as terms from termed where is_doc and len(ts) > 0
), weights as (
    select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w
    from tf, sizes where is_doc group by term
), impacts as (
    select row_id, id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)) as x
    from tf, sizes where is_doc
), scores as (
    select q.row_id as item_row, q.id as item_id, d.row_id, d.id as doc_id, sum(q.tf * w * x)::bigint as score
    from tf q join weights using (term) join impacts d using (term)
    where not q.is_doc
    group by all
)
select item_id, row_number() over (partition by item_row order by score desc, doc_id)::int as rank, doc_id, score
from scores where score > 0
qualify rank <= 10
"""


def op13_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and model log10 probability of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _held_out(5, 1).alias("held_out"))
    return maxent.scored(docs, maxent.learned(docs.where("not held_out")), ["doc_id", "held_out"])


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to query."""
    found = (
        op1_line_dedup,
        op2_repeats,
        op3_simhash,
        op4_embedding,
        op5_mixing,
        op6_quality_rules,
        op7_toxicity,
        op8_warc,
        op9_bpe,
        op10_quality_net,
        op11_collocations,
        op12_lexical,
        op13_maxent,
    )
    return {f.__name__: f for f in found}


def statements() -> dict[str, str]:
    """Query name to the SQL that gives the same rows."""
    return {"op8_warc": OP8, "op11_collocations": OP11, "op12_lexical": OP12}
