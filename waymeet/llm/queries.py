"""The corpus queries, as (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, exact_dedup, licenses, main_text, negatives, packing, quality, simhash, token_counts, toxicity, url_filter, warc
from .common import scratch_path, table
from .sampling import fold_of
from .words import CAPITALS, SMALL


#: (host, path, verdict) of the rules that op6 applies (fixed values).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path() -> str:
    """The vocabulary file that packing and token counts use here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _judged(found: DataFrame, held_out) -> DataFrame:
    return found.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents"), tokenizer_path()))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _judged(quality.score(docs, model), held_out)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("text_key")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, with_payload=False).drop("url", "payload")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _judged(toxicity.score(docs, model), held_out)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(table(spark, sf_dir, "pages"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.select("vec_id", "embedding", moved.alias("label")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.summaries(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_url_filters": op6_url_filters,
    "op7_warc": op7_warc,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_license_scans": op9_license_scans,
    "op10_toxicity": op10_toxicity,
    "op11_html_extraction": op11_html_extraction,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}

WHITE_SQL = r"[\x20\x09-\x0D]"
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _values(rows: list[tuple]) -> str:
    say = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()
    return ", ".join(f"({', '.join(map(say, r))})" for r in rows)


SQL = {
    "op4_exact_dedup": rf"""
        with t as (
            select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '{WHITE_SQL}', '', 'g') as body
            from documents
        )
        select doc_id,
               first_value(doc_id) over (partition by body order by length(text) desc, doc_id) as keep_id,
               count(*) over (partition by body) as group_size,
               row_number() over (partition by body order by length(text) desc, doc_id) = 1 as kept,
               sha256(body) as text_sha256
        from t
    """,
    "op6_url_filters": f"""
        with r(host, path, verdict) as (values {_values(URL_RULES)}),
        p as (
            select row_number() over () as row_no, page_id,
                   translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{CAPITALS}', '{SMALL}') as host,
                   regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
            from pages
        )
        select page_id, p.host, p.path, r.host || r.path as rule, coalesce(r.verdict, 'allow') as verdict
        from p left join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
        qualify row_number() over (partition by row_no order by length(r.host || r.path) desc nulls last, length(r.host) desc, r.verdict desc) = 1
    """,
    "op7_warc": """
        with d as (select page_id, encode(coalesce(html, '')) as body, sha1(encode(coalesce(html, ''))) as hex from pages),
        m as (select *, max(page_id) over (partition by hex) as last from d)
        select page_id, octet_length(body)::bigint as payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
                   ((instr('0123456789abcdef', substr(hex, 1 + (5 * i) // 4, 1)) - 1) * 16 + greatest(instr('0123456789abcdef', substr(hex, 2 + (5 * i) // 4, 1)) - 1, 0))
                   >> (3 - (5 * i) % 4)::int) & 31)::int, 1)), '') as payload_digest,
               case when page_id < last then 'revisit' else 'response' end as record_type,
               case when page_id < last then last end as refers_to
        from m
    """,
    "op8_benchmark_decontamination": rf"""
        with a as (select doc_id as id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{WORD_SQL}') as w from documents),
        b as (select item_id as id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{WORD_SQL}') as w from benchmark),
        da as (select distinct id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4)) when len(w) > 0 then [w] else [] end) as s from a),
        db as (select distinct id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4)) when len(w) > 0 then [w] else [] end) as s from b),
        n as (select id, count(*) as n from db group by id)
        select da.id as doc_id, db.id as item_id, n.n as n_shingles, count(*) as n_shared, count(*) / n.n as containment
        from db join n on db.id = n.id join da on da.s = db.s
        group by da.id, db.id, n.n
        having count(*) / n.n >= 0.8
    """,
    "op9_license_scans": rf"""
        with t(template, label, base, k, q, gram, n_grams) as (values {_values(licenses.template_grams(licenses.PHRASES, licenses.NOTICES))}),
        w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{WORD_SQL}') as w from documents),
        g as (
            select doc_id, 2 as k, i - 1 as p, array_to_string(list_slice(w, i, i + 1), ' ') as gram
            from (select doc_id, w, unnest(range(1, len(w))) as i from w)
            union all
            select doc_id, 3 as k, i - 1 as p, array_to_string(list_slice(w, i, i + 2), ' ') as gram
            from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)
        ),
        v as (
            select distinct doc_id, template, label, base, n_grams, p - q as diagonal, q
            from g join t on g.k = t.k and g.gram = t.gram
        ),
        u as (
            select *, count(distinct q) over (partition by doc_id, template order by diagonal range between current row and {licenses.SLACK} following)::double / n_grams as share
            from v
        ),
        d as (
            select doc_id, count(*) filter (base) as n_base, min(diagonal) filter (base) as first_word, max(diagonal) filter (base) as last_word,
                   string_agg(distinct label, ',' order by label) filter (base) as base_labels,
                   string_agg(distinct label, ',' order by label) filter (share >= {licenses.COVERAGE}) as labels, max(share) as score
            from u group by doc_id
        )
        select w.doc_id, len(w.w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
               coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
        from w left join d on w.doc_id = d.doc_id
    """,
    # what the article of a page is where its markup says so, as in these tables
    "op11_html_extraction": r"""
        with a as (
            select page_id, url, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<(script|style|nav|footer|header|aside|form)\b.*?</(script|style|nav|footer|header|aside|form)>', '', 'g') as h
            from pages
        ),
        b as (
            select page_id, url, list_transform(
                regexp_split_to_array(regexp_extract(h, '(?is)<article\b[^>]*>(.*)</article>', 1), '(?i)</?(p|h[1-6]|div|li|ul|ol|section|blockquote)\b[^>]*>'),
                lambda x: trim(regexp_replace(
                    replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'),
                        '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&(#39|#x27|apos);', chr(39), 'g'), '&amp;', '&amp').replace('&amp', '&'),
                    '\s+', ' ', 'g'))) as parts
            from a
        ),
        t as (select page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) as text from b)
        select page_id, url, text, length(text) as n_chars from t
    """,
    "op12_hard_negatives": """
        with e as (
            select row_number() over () as n, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda x: floor(256 * x::double)) as v
            from embeddings
            where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        a as (
            select a.n, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
            from e a join e b on a.n <> b.n
            where a.vec_id % 100 = 0
        ),
        p as (
            select n, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by n order by score desc, vec_id) as slot
            from a where same qualify slot <= 5
        )
        select p.anchor_id, positive_id, row_number() over (partition by p.n, slot order by a.score desc, a.vec_id)::integer as rank,
               a.vec_id as negative_id, positive_score, a.score as negative_score
        from p join a on p.n = a.n and not a.same and 30 * positive_score <= 100 * a.score and 100 * a.score <= 90 * positive_score
        qualify rank <= 10
    """,
    "op13_conversation_repair": rf"""
        with recursive k as (
            select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, _: xor(c >> 1, (c & 1) * 3988292384))) as crc_of
        ),
        g as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                   coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
            from conversations
        ),
        f as (
            select g.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::bigint)),
                   lambda c, b: xor(c >> 8, crc_of[1 + (xor(c, b) & 255)])), 4294967295) % 20 as what
            from g, k
        ),
        d as (
            select conv_id, turn, case when what = 4 then 'user' else role end as role,
                   case what when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case what when 0 then 0 when 3 then 2 else 1 end)) as copy
            from f
        ),
        o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d),
        j as (
            select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
                           when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                           when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault,
                   substr(role, 1, 1) as c, lag(substr(role, 1, 1)) over (partition by conv_id order by i) as before
            from o
        ),
        counts as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
                   count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
                   count(*) filter (i > 1 and before || c not in ('su', 'ua', 'au')) as illegal, max(i) as n
            from j group by conv_id
        ),
        ids as (select distinct conv_id from g),
        dp as (
            select conv_id, 0::bigint as i, {{'c': 0::bigint, 'a': ''}} as s0, {{'c': 1000000000000::bigint, 'a': ''}} as s1,
                   {{'c': 5::bigint, 'a': 'I'}} as s2, {{'c': 10::bigint, 'a': 'II'}} as s3
            from ids
            union all
            select conv_id, i, t0, t1, u2, list_min([t3, {{'c': u2.c + 5, 'a': u2.a || 'I'}}])
            from (
                select conv_id, i, t0, t1, t3,
                       list_min([t2, {{'c': t0.c + 5, 'a': t0.a || 'I'}}, {{'c': t1.c + 5, 'a': t1.a || 'I'}}, {{'c': t3.c + 5, 'a': t3.a || 'I'}}]) as u2
                from (
                    select j.conv_id, j.i, {{'c': s0.c + 2, 'a': s0.a || 'D'}} as t0,
                           case when dead or j.c <> 's' then {{'c': s1.c + 2, 'a': s1.a || 'D'}} else list_min([{{'c': s1.c + 2, 'a': s1.a || 'D'}}, {{'c': s0.c + more, 'a': s0.a || 'K'}}]) end as t1,
                           case when dead then {{'c': s2.c + 2, 'a': s2.a || 'D'}} else
                               list_min([{{'c': s2.c + 2, 'a': s2.a || 'D'}}, {{'c': s0.c + more + to_u, 'a': s0.a || by_u}}, {{'c': s1.c + more + to_u, 'a': s1.a || by_u}}, {{'c': s3.c + more + to_u, 'a': s3.a || by_u}}]) end as t2,
                           case when dead then {{'c': s3.c + 2, 'a': s3.a || 'D'}} else list_min([{{'c': s3.c + 2, 'a': s3.a || 'D'}}, {{'c': s2.c + more + to_a, 'a': s2.a || by_a}}]) end as t3
                    from dp join (
                        select *, fault in ('blank', 'duplicate') as dead, case fault when 'truncated' then 5 else 0 end as more,
                               (c <> 'u')::int as to_u, case when c = 'u' then 'K' else 'R' end as by_u, (c <> 'a')::int as to_a, case when c = 'a' then 'K' else 'R' end as by_a
                        from j
                    ) as j on j.conv_id is not distinct from dp.conv_id and j.i = dp.i + 1
                )
            )
        ),
        best as (
            select ids.conv_id, gaps, blank, duplicate, truncated, illegal, list_min([s0, s3]) as e
            from ids left join counts on ids.conv_id is not distinct from counts.conv_id
            join dp on dp.conv_id is not distinct from ids.conv_id and dp.i = coalesce(n, 0)
        ),
        letters as (select conv_id, e.a as audit, unnest(range(1, length(e.a) + 1)) as p from best),
        steps as (
            select conv_id, p, substr(audit, p, 1) as edit, length(replace(substr(audit, 1, p), 'I', '')) as i, length(replace(substr(audit, 1, p), 'D', '')) as pos
            from letters
        ),
        kept as (
            select s.conv_id, s.pos, s.edit, case when s.edit = 'I' then '' else j.text end as text, j.role,
                   s.pos = 1 and s.edit = 'K' and j.c = 's' as is_system
            from steps s left join j on s.conv_id is not distinct from j.conv_id and s.i = j.i
            where s.edit <> 'D'
        ),
        said as (
            select conv_id, pos, text, case when edit = 'K' then role when (pos - max(is_system::int) over (partition by conv_id)) % 2 = 1 then 'user' else 'assistant' end as role
            from kept
        ),
        whole as (select conv_id, string_agg(role || ':' || text, chr(10) order by pos) as t from said group by conv_id)
        select best.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
               coalesce(illegal, 0) as illegal, e.c as cost, e.a as audit, sha256(coalesce(t, '')) as repaired_sha256
        from best left join whole on best.conv_id is not distinct from whole.conv_id
    """,
}
