"""Registered queries of the operators, each over its whole table, with SQL where SQL can express it."""

import public_tokenizers
from pyspark.sql import functions as F

from netloom.llm import bpe, filter_audit, katz_lm, merkle, ngram_join, packing, quality_classifier, quality_rules, secret_scans, spot_signatures, topk_search, url_filters, warc
from netloom.llm.common import crc_mod, table


def op1_spot_signatures(spark, sf_dir):
    return spot_signatures.edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    weights = quality_classifier.train(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    return (quality_classifier.score(docs, weights)
            .select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")))


def op4_quality_rules(spark, sf_dir):
    return (quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "level", "cut"))


def op3_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_bpe(spark, sf_dir):
    return bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op6_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: equal payloads are grouped by digest and length; page ids are unique
WARC_SQL = """
    with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
    q as (select *, max(page_id) over (partition by d, n) as top from p)
    select page_id, n as payload_bytes, d as payload_digest, case when n >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
           case when n >= 1000 and page_id < top then top end as refers_to from q"""


def op7_secret_scans(spark, sf_dir):
    s = secret_scans
    return (s.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
            .select("doc_id", *[s.counted("base", k).alias(f"n_{k}") for k in s.BASE],
                    F.sha2(s.written("base"), 256).alias("base_sha256"), s.written("found").alias("spans")))


def op8_ngram_join(spark, sf_dir):
    return ngram_join.joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: fixed values: the query's rules, and words of host labels that its list blocks where no rule fits
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
WORDS = """ad ads adserver adtrack adult affiliate bet bets betting bingo casino casinos clickbait coupon crack cracked dating download escort
    forex gamble gambling hack hentai jackpot keygen loan loans lottery malware nude payday pharma pharmacy phishing pills piracy poker popup porn
    porno promo proxy ringtone scam sex slots spam spyware sweepstakes torrent torrents tracker tracking viagra virus warez webcam xxx""".split()


def op9_url_filters(spark, sf_dir):
    lists = url_filters.as_table(spark, RULES, words=WORDS)
    return url_filters.judge_lists(table(spark, sf_dir, "pages").select("page_id", "url"), lists)


def _url_sql():
    fits = {r: (f"(host = '{r.split('/')[0]}' or ends_with(host, '.{r.split('/')[0]}')) and starts_with(path, '{r[r.index('/'):]}')") for _, r in RULES}
    longest = sorted(RULES, key=lambda x: -len(x[1]))
    words = ", ".join(f"'{w}'" for w in WORDS)
    label = f"list_has_any(string_split(replace(host, '-', '.'), '.'), [{words}])"
    return f"""
    with a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    b as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from a),
    c as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
          regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from b)
    select page_id, host, path, case {' '.join(f"when {fits[r]} then '{r}'" for _, r in longest)} end as rule,
           case {' '.join(f"when {fits[r]} then '{v}'" for v, r in longest)} when {label} then 'block' else 'allow' end as verdict from c"""


def op10_katz_lm(spark, sf_dir):
    return katz_lm.scores(table(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod("doc_id", 7) == 2, least=1)


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


AUDIT_SQL = r"""
    with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
    w as (select *, regexp_replace(t, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as trimmed from t),
    d as (select *, case when trimmed = '' then [] else string_split_regex(trimmed, '[\x20\x09-\x0D]+') end as words from w),
    f as (select doc_id, part, (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
          + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
          + 16 * (doc_id > min(doc_id) over (partition by t))::int as mask from d),
    lab as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by 1),
    c as (select part, mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n from f left join lab using (doc_id) group by all),
    l as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as b),
    o as (select v.f || w.f || x.f || y.f || z.f as filter_order, [v.b, w.b, x.b, y.b, z.b] as bits from l v, l w, l x, l y, l z
          where len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
    s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::bigint as before from o, unnest([1, 2, 3, 4, 5]) as u(step)),
    r as (select part, filter_order, step, bit, sum(case when mask & (before | bit) = 0 then n else 0 end)::bigint as kept,
          sum(case when mask & bit > 0 and mask & before = 0 then n else 0 end)::bigint as removed,
          sum(case when mask & bit > 0 and mask & before > 0 then n else 0 end)::bigint as redundant,
          sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
          sum(case when mask & bit > 0 and mask & before = 0 and good then n else 0 end)::bigint as good_lost,
          sum(case when mask & bit > 0 and mask & before = 0 and toxic then n else 0 end)::bigint as toxic_lost
          from c, s group by all)
    select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) over (partition by part, bit))::bigint as shapley from r"""


def op12_merkle_manifest(spark, sf_dir):
    odd = F.col("doc_id").isNotNull() & (crc_mod("doc_id", 2) == 0)
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), odd))


def _merkle_sql(levels=13):
    """Levels are unrolled, enough for 3 ** 13 rows; a group of one node keeps it as it is."""
    crc = """list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
             lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, i: xor(x >> 1, 3988292384::bigint * (x & 1))))"""
    field = lambda c: f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    sql = [f"""a as (select doc_id, source, {leaf("text")} as leaf, case when xor({crc}, 4294967295) % 2 = 0
                          then {leaf("replace(text, chr(10), '')")} else {leaf("text")} end as h from documents)""",
           "l as materialized (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from a)",
           "n0 as materialized (select source as of, i, leaf as d from l)"]
    last = "l"
    for side, depth in (("n", levels), ("m", 6)):
        if side == "m":
            sql.append(f"m0s as (select of as source, d, row_number() over (order by of nulls first) - 1 as i from n{levels})")
            sql.append("m0 as materialized (select 0 as of, i, d, source from m0s)")
            sql.append(f"top as (select {last}.* exclude (i), m0.i, m0.d as subroot from {last} join m0 on m0.source is not distinct from {last}.source)")
            last = "top"
        for k in range(depth):
            near = "coalesce(string_agg(d, '') over (partition by of, i // 3 order by i rows between {}), '')"
            same = f"q.of is not distinct from {last}.source and " if side == "n" else ""
            sib = f"{last}.sib" if last != "l" else "''"
            old = f"{last}.* exclude (i, h{', sib' if last != 'l' else ''})"
            sql += [f"{side}{k}x as materialized (select of, i, d, count(*) over (partition by of) as c, {near.format('unbounded preceding and 1 preceding')} as bf, "
                    f"{near.format('1 following and unbounded following')} as af from {side}{k})",
                    f"{side}{k + 1} as materialized (select of, i // 3 as i, case when max(c) = 1 then max(d) else sha256(string_agg(d, '' order by i)) end as d "
                    f"from {side}{k}x group by of, i // 3)",
                    f"{side}p{k} as materialized (select {old}, {last}.i // 3 as i, {sib} || q.bf || q.af as sib, "
                    f"case when q.c > 1 then sha256(q.bf || {last}.h || q.af) else {last}.h end as h from {last} join {side}{k}x q on {same}q.i = {last}.i)"]
            last = f"{side}p{k}"
    return "with " + ", ".join(sql) + f""" select doc_id, leaf, subroot, m6.d as root, sha256(sib) as proof_sha256, h as folded_root, h = m6.d as verified from {last}, m6"""


def op13_topk_search(spark, sf_dir):
    return topk_search.top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


TOPK_SQL = """
    with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
               where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from e q join e c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    select query_id, rank::int as rank, vec_id, score from r where rank <= 5"""


QUERIES = {f.__name__: f for f in (op1_spot_signatures, op2_quality_classifier, op3_packing, op4_quality_rules, op5_bpe, op6_warc, op7_secret_scans, op8_ngram_join,
                                   op9_url_filters, op10_katz_lm, op11_filter_audit, op12_merkle_manifest, op13_topk_search)}
ORACLES = {"op6_warc": WARC_SQL, "op9_url_filters": _url_sql(), "op11_filter_audit": AUDIT_SQL, "op12_merkle_manifest": _merkle_sql(), "op13_topk_search": TOPK_SQL}
