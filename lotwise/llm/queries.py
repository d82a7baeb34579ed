"""The registered queries of this subpackage: thin applications of the operators to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import encode_documents
from .bpe_count import count_tokens
from .collocations import mine_collocations
from .common import table
from .decontaminate import find_leaks
from .filter_audit import audit_filters
from .fingerprints import fingerprint_edits
from .html_text import extract_pages
from .near_dedup import near_duplicate_classes
from .pseudo_likelihood import fit_and_score
from .quality import fit_quality, score_quality
from .secrets import scan_secrets
from .toxicity import fit_toxicity, score_toxicity
from .window_dedup import remove_repeated_windows


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_toxicity(docs, fit_toxicity(docs, labels))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_and_score(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_quality(docs, fit_quality(docs, labels))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_toxicity": op2_toxicity,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_token_counts": op7_token_counts,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_secret_scans": op10_secret_scans,
    "op11_filter_audit": op11_filter_audit,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op11_filter_audit": r"""
with texts as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
    from documents
), judged as (
    select doc_id, part,
           (len(words) < 200)::int as a,
           (100 * len(list_distinct(words)) < 50 * len(words))::int as b,
           (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::int as c,
           regexp_matches(text, '[#$%&*|]')::int as d,
           coalesce(doc_id > min(doc_id) over (partition by text), false)::int as e
    from texts
), marks as (
    select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as bad from labels group by doc_id
), rows_ as (
    select part, [a, b, c, d, e] as f, coalesce(good, 0) as good, coalesce(bad, 0) as bad
    from judged left join marks using (doc_id)
), letters as (
    select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
    select [p.x, q.x, r.x, s.x, t.x] as o
    from letters p, letters q, letters r, letters s, letters t
    where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), places as (
    select array_to_string(o, '') as filter_order, list_transform(o, lambda x: ascii(x) - 64) as k from orders
), reached as (
    select part, filter_order, k, good, bad, f,
           coalesce(list_position(list_transform(k, lambda i: f[i]), 1), 6) as stop
    from rows_, places
), steps as (
    select unnest([1, 2, 3, 4, 5]) as step
)
select part, filter_order, step,
       sum((stop > step)::int)::bigint as kept,
       sum((stop = step)::int)::bigint as removed,
       sum((f[k[step]] = 1 and stop < step)::int)::bigint as redundant,
       sum((f[k[step]] = 1 and list_sum(f) = 1)::int)::bigint as unique_fails,
       sum((stop = step and good = 1)::int)::bigint as good_lost,
       sum((stop = step and bad = 1)::int)::bigint as toxic_lost,
       (sum(sum((stop = step)::int)) over (partition by part, k[step]))::bigint as shapley
from reached, steps
group by part, filter_order, step, k
""",
    "op12_phrase_collocations": r"""
with pieces as (
    select coalesce(lang, 'und') as lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), words as (
    select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces
), places as (
    select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, (select unnest([1, 2, 3]) as k) sizes
), phrases as (
    select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*) as f from places group by all
), totals as (
    select lang, sum(f) as n from phrases where k = 1 group by lang
), cuts as (
    select c.lang, c.phrase, c.k as size, c.f as a, cut, string_split(c.phrase, ' ') as w
    from phrases c, (select unnest([1, 2]) as cut) k where c.k > 1 and c.f >= 10 and cut < c.k
), scored as (
    select u.lang, u.phrase, u.size, u.a, u.cut, x.f as l, y.f as r,
           (1000000::hugeint * u.a * u.a) // (x.f::hugeint * y.f) as score
    from cuts u
    join phrases x on x.lang = u.lang and x.phrase = array_to_string(u.w[1 : u.cut], ' ')
    join phrases y on y.lang = u.lang and y.phrase = array_to_string(u.w[u.cut + 1 :], ' ')
), lowest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), longer as (
    select lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) as phrase, f
    from phrases where k = 3 and f >= 10
), hiding as (
    select lang, phrase, max(f) as f from longer group by lang, phrase
), left_over as (
    select s.* from lowest s left join hiding h on h.lang = s.lang and h.phrase = s.phrase and s.size = 2
    where h.f is null or 100 * h.f < 50 * s.a
)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_over) join totals using (lang)
where rank <= 2000
""",
}
