"""Thin opN queries: production parameters, whole tables, digest columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.llm import conversation_repair as repair, langid, secret_scan, toxicity
from quire.llm.divergence import source_divergence
from quire.llm.inverted_index import contamination
from quire.llm.jaccard_join import jaccard_classes
from quire.llm.packing import pack_tokens
from quire.llm.pii import KINDS, pii_spans, span_list
from quire.llm.pseudo_likelihood import pseudo_likelihood
from quire.llm.quality import quality_rules
from quire.llm.registry import read, register
from quire.llm.token_counts import token_counts
from quire.llm.warc import resolve_revisits
from quire.session import materialize, scratch_path


@register("op2_packing")
def op2(spark, sf_dir):
    pieces = pack_tokens(read(spark, sf_dir, "documents"), capacity=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


_LOWER = "translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all({_LOWER.format(c='text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format(c='text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
      FROM benchmark),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(words)) AS k, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS w
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(words) - 9))) AS i FROM b WHERE len(words) > 0)),
dw AS (
  SELECT rid, i, k, array_to_string(words[i:i + k - 1], ' ') AS w
  FROM (SELECT rid, words, k, unnest(generate_series(1, len(words) - k + 1)) AS i
        FROM d, (SELECT DISTINCT k FROM bw) WHERE len(words) >= k)),
hit AS MATERIALIZED (SELECT rid, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.w = bw.w),
n AS (SELECT rid, count(DISTINCT i + o) AS n FROM hit, (SELECT unnest(range(0, 10)) AS o) WHERE o < k GROUP BY rid),
t AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_hit,
       CAST(len(coalesce(items, []::VARCHAR[])) AS BIGINT) AS n_items,
       sha256(array_to_string(coalesce(items, []::VARCHAR[]), ',')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""


@register("op3_decontamination", DECONTAMINATION_SQL)
def op3(spark, sf_dir):
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@register("op4_token_counts")
def op4(spark, sf_dir):
    counts = token_counts(read(spark, sf_dir, "documents"), scratch_path(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens",
                         F.coalesce(F.col("n_tokens") > 1024, F.lit(False)).alias("over_limit"))


JACCARD_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format(c='text')}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + least(5, len(words)) - 1], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM d WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS least_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least_id, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id
"""


@register("op6_jaccard_join", JACCARD_SQL)
def op6(spark, sf_dir):
    return jaccard_classes(read(spark, sf_dir, "documents"), k=5, percent=80).select(
        "doc_id", "n_shingles", "component_id")


QUALITY_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS MATERIALIZED (
  SELECT rid, doc_id, source, t,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
win AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 7)) AS i FROM m WHERE len(words) >= 8)),
twice AS (SELECT rid, w FROM win GROUP BY rid, w HAVING count(*) > 1),
rep AS (
  SELECT rid, count(DISTINCT i + o) AS n
  FROM win SEMI JOIN twice USING (rid, w), (SELECT unnest(generate_series(0, 7)) AS o) GROUP BY rid),
base AS MATERIALIZED (
  SELECT rid, doc_id, source, t, lines, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM m LEFT JOIN rep USING (rid)),
texts AS MATERIALIZED (SELECT source, t, any_value(lines) AS lines FROM base GROUP BY source, t),
l AS MATERIALIZED (
  SELECT source, t, trim(regexp_replace(lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]+', '0', 'g')) AS norm,
         len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
  FROM (SELECT source, t, unnest(lines) AS x FROM texts)),
hosts AS (SELECT source, count(*) AS texts FROM texts GROUP BY source),
above AS (
  SELECT l.source, norm FROM l JOIN hosts ON l.source IS NOT DISTINCT FROM hosts.source
  GROUP BY l.source, norm, texts HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > 0.01 * texts),
gone AS (
  SELECT l.source, l.t, sum(n) AS n FROM l JOIN above
    ON l.source IS NOT DISTINCT FROM above.source AND l.norm = above.norm GROUP BY l.source, l.t),
v AS (
  SELECT base.*, coalesce(gone.n, 0) AS n_gone,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM base LEFT JOIN gone ON base.source IS NOT DISTINCT FROM gone.source AND base.t = gone.t)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_gone > 0 AND (n_words - n_gone < 20 OR n_words - n_gone < 0.3 * n_words)) AS kept,
       CAST(n_gone AS BIGINT) AS n_line_words
FROM v
"""


@register("op10_quality_rules", QUALITY_SQL)
def op10(spark, sf_dir):
    return quality_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "n_line_words")


@register("op1_pii")
def op1(spark, sf_dir):
    found = pii_spans(read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
                        span_list(F.col("spans")).alias("spans"))


def captures(spark, sf_dir):
    """A capture table from ``pages``: each page is a full response and, later
    (or, for some, before any response), a not-modified revisit under a variant
    of its URL, with a strong tag, a weak tag, a date or a differing tag."""
    page, n = F.col("page_id"), F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 2), 16, 10).cast("int")
    p = read(spark, sf_dir, "pages").select(
        "page_id", "url", "html", n.alias("n"), F.md5("html").alias("m"),
        F.concat(F.lit("day "), page.cast("string")).alias("day"))
    tag = F.concat(F.lit('"'), F.col("m"), F.lit('"'))
    response = p.select(
        (2 * page).alias("id"), "url", (1000 * page).alias("time"), F.lit("response").alias("kind"), tag.alias("etag"),
        F.col("day").alias("last_modified"), F.col("m").alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag, F.lit("date"), F.col("day")).alias("headers"),
        F.col("html").alias("payload"))
    sent = (F.when(F.col("n") % 4 == 0, tag).when(F.col("n") % 4 == 1, F.concat(F.lit("W/"), tag))
            .when(F.col("n") % 4 == 2, F.lit(None).cast("string")).otherwise(F.lit('"other"')))
    revisit = p.select(
        (2 * page + 1).alias("id"), F.concat("url", F.lit("#again")).alias("url"),
        F.when(F.col("n") < 250, 1000 * page + 37 * F.col("n")).otherwise(-page).alias("time"),
        F.lit("revisit").alias("kind"), sent.alias("etag"), F.col("day").alias("last_modified"), F.col("m").alias("digest"),
        F.create_map(F.lit("date"), F.concat(F.lit("later "), F.col("day")), F.lit("content-type"), F.lit("none"),
                     F.lit("vary"), F.when(F.col("n") % 2 == 0, "accept")).alias("headers"),
        F.lit(None).cast("string").alias("payload"))
    return response.unionByName(revisit)


WARC_SQL = r"""
WITH p AS (
  SELECT page_id, html, md5(html) AS m, CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS INTEGER) AS n,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u
  FROM pages),
k AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www\.', ''), ':(?:80|443)$', '')
           || regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/index\.html?$', '/'), '/+$', '') AS hp,
         list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)'))) AS q
  FROM p),
c AS (SELECT *, hp || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM k),
s AS (SELECT 2 * page_id AS id, 1000 * page_id AS time, url, m, page_id, html FROM c),
r AS (SELECT 2 * page_id + 1 AS id, CASE WHEN n < 250 THEN 1000 * page_id + 37 * n ELSE -page_id END AS time, url, m, n, page_id FROM c),
f AS (
  SELECT r.*, s.id AS response_id, s.m AS sm, s.page_id AS sp, s.html AS sh,
         row_number() OVER (PARTITION BY r.id ORDER BY s.time DESC, s.id DESC) AS nth
  FROM r LEFT JOIN s ON r.url = s.url AND (s.time < r.time OR (s.time = r.time AND s.id < r.id))),
v AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'unresolved'
                 WHEN (n % 4 IN (0, 1) AND m = sm) OR (n % 4 = 2 AND page_id = sp) THEN 'resolved' ELSE 'changed' END AS verdict
  FROM f WHERE nth = 1)
SELECT id, url AS canonical_url, response_id, verdict,
       CASE WHEN verdict = 'resolved'
            THEN 'content-type=text/html,date=later day ' || page_id || ',etag="' || sm || '"' || CASE WHEN n % 2 = 0 THEN ',vary=accept' ELSE '' END
            ELSE 'content-type=none,date=later day ' || page_id || ',vary=' || CASE WHEN n % 2 = 0 THEN 'accept' ELSE '' END END AS headers,
       CASE WHEN verdict = 'resolved' THEN sha256(sh) END AS payload_sha256
FROM v
"""


@register("op7_warc_revisits", WARC_SQL)
def op7(spark, sf_dir):
    done = resolve_revisits(captures(spark, sf_dir))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    return done.select("id", "canonical_url", "response_id", "verdict", F.array_join(entries, ",").alias("headers"),
                       F.sha2("payload", 256).alias("payload_sha256"))


@register("op8_langid")
def op8(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held_out = langid.fold_of(F.col("doc_id"), 5) == 0
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register("op9_toxicity")
def op9(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = langid.fold_of(F.col("doc_id"), 4) == 2
    model = toxicity.train(labels.where(~held_out), docs=docs)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score",
                                              (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op5_lm_scoring")
def op5(spark, sf_dir):
    return pseudo_likelihood(read(spark, sf_dir, "documents"))


@register("op11_secret_scan")
def op11(spark, sf_dir):
    found = secret_scan.secret_spans(read(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[of_kind(k) for k in secret_scan.BASE_KINDS],
                        F.sha2(secret_scan.span_list(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.span_list(F.col("spans")).alias("spans"))


DIVERGENCE_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWER.format(c='text')}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (kept.n + 2)) // (l.total + 2 * l.v) AS q
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM r WHERE part = 'pair' OR rank <= 10
"""


@register("op13_source_divergence", DIVERGENCE_SQL)
def op13(spark, sf_dir):
    return source_divergence(read(spark, sf_dir, "documents"))


def _step_sql(state: int) -> str:
    """The cheapest (cost, audit, text) of a row in a state, before insertions."""
    after = ["v2", "v2", "v3", "v2"][state]
    name = "assistant" if state == 2 else "user"
    keeps = {0: "WHEN 's' THEN v1 WHEN 'u' THEN v2", 1: "WHEN 'u' THEN v2", 2: "WHEN 'a' THEN v3", 3: "WHEN 'u' THEN v2"}[state]
    keep = f"(CASE left(x.role, 1) {keeps} END)"
    line = "chr(10) || x.role || ':' || x.text"
    return f"""list_min(list_filter([
      {{'c': 4 + v{state}.c, 'e': 'D' || v{state}.e, 't': v{state}.t}},
      CASE WHEN NOT gone THEN {{'c': extra + {keep}.c, 'e': 'K' || {keep}.e, 't': {line} || {keep}.t}} END,
      CASE WHEN NOT gone THEN {{'c': 3 + extra + {after}.c, 'e': 'R' || {after}.e, 't': chr(10) || '{name}:' || x.text || {after}.t}} END
      ], lambda y: y.c IS NOT NULL))"""


def _insert_sql(v: str, w: str, name: str) -> str:
    return f"list_min([{v}, {{'c': 3 + {w}.c, 'e': 'I' || {w}.e, 't': chr(10) || '{name}:' || {w}.t}}])"


REPAIR_SQL = rf"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)),
h AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda z: ascii(z)::BIGINT)),
             lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 20 AS h
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations), crc),
d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM h WHERE h <> 0),
o AS MATERIALIZED (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS cid, *,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM d),
f AS MATERIALIZED (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY i) || left(role, 1) AS met,
         max(i) OVER (PARTITION BY cid) AS n
  FROM o),
x AS MATERIALIZED (
  SELECT cid, i, role, text, fault IS NOT NULL AND fault <> 'truncated' AS gone,
         CASE WHEN fault IS NOT NULL AND fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM f),
r(cid, i, v0, v1, v2, v3) AS (
  SELECT cid, max(i) + 1, {{'c': 0::BIGINT, 'e': '', 't': ''}},
         {{'c': 6::BIGINT, 'e': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}},
         {{'c': 3::BIGINT, 'e': 'I', 't': chr(10) || 'assistant:'}}, {{'c': 0::BIGINT, 'e': '', 't': ''}}
  FROM x GROUP BY cid
  UNION ALL
  SELECT cid, i, {_insert_sql("b.v0", "b.v2", "user")}, {_insert_sql("b.v1", "b.v2", "user")}, b.v2, {_insert_sql("b.v3", "b.v2", "user")}
  FROM (
    SELECT cid, i, w0 AS v0, w1 AS v1, {_insert_sql("w2", "w3a", "assistant")} AS v2, w3 AS v3
    FROM (SELECT *, {_insert_sql("w3", "w2", "user")} AS w3a
          FROM (SELECT x.cid, x.i, {_step_sql(0)} AS w0, {_step_sql(1)} AS w1, {_step_sql(2)} AS w2, {_step_sql(3)} AS w3
                FROM r JOIN x ON x.cid = r.cid AND x.i = r.i - 1))) b),
best AS (SELECT cid, v0 FROM r WHERE i = 1),
counts AS (
  SELECT cid, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE i > 1 AND coalesce(met, '') NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY cid)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v0.c, 0) AS cost, coalesce(v0.e, '') AS audit,
       sha256(substr(coalesce(v0.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts ON c.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN best ON best.cid = counts.cid
"""


@register("op12_conversation_repair", REPAIR_SQL)
def op12(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    done = materialize(repair.repair(repair.damaged(rows)), "repaired")
    found = repair.report(done).join(repair.digests(done).withColumnRenamed("conv_id", "same"), F.col("conv_id").eqNullSafe(F.col("same")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    return every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
