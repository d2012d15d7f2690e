"""The registered queries of this subpackage and their DuckDB oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from .common import table, text_of
from .conversations import repair_conversations
from .exact_dedup import exact_duplicates
from .fill_middle import fill_in_middle
from .line_dedup import drop_repeated_lines
from .minhash import near_duplicates
from .mixing import BLOCK_WORDS, MAX_EPOCHS, SEED, mix_sources
from .packing import pack_documents
from .quality_pu import quality_scores
from .quality_rules import quality_rules
from .repeats import remove_repeats
from .secret_scan import scan_digest
from .url_filter import judge_urls, rules_frame
from .warc import round_trip

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


@query("op1_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS place,
             first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, h AS text_sha256 FROM r""")
def op1_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


_SPANS = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
}


def _found_sql(no: int, kind: str) -> str:
    pattern, group, least = _SPANS[kind]
    return rf"""
SELECT doc_id, {no} AS no, '{kind}' AS kind, e - length(m) AS s, e FROM (
  SELECT doc_id, m, g, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(gs) AS g, unnest(ps) AS p, unnest(range(len(ms))) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs,
             regexp_split_to_array(t, '{pattern}')[:len(regexp_extract_all(t, '{pattern}', 0))] AS ps FROM t)))
WHERE length(g) >= {least}"""


@query("op3_secret_scan", f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_found_sql(i, k) for i, k in enumerate(_SPANS))}),
x AS (SELECT *, kind || ':' || s::BIGINT || ':' || e::BIGINT AS span FROM f),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY s, no) FILTER (no < 3) AS base,
             string_agg(span, ',' ORDER BY s, no) AS spans FROM x GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a ON t.doc_id = a.doc_id""")
def op3_secret_scan(spark, sf_dir):
    return scan_digest(table(spark, sf_dir, "documents"))


@query("op4_mix_sources", rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size)::BIGINT * {MAX_EPOCHS} AS cap,
             row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight FROM s),
c AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
             coalesce(sum(cap) OVER q, 0) AS caps_before, coalesce(sum(weight) OVER q, 0) AS weights_before FROM w
      WINDOW q AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, cap * (weights - weights_before) <= weight * (total - caps_before) AS stops FROM c),
t AS (SELECT source, rank, source_size, total,
             CASE WHEN stops THEN cap::DOUBLE ELSE (weight * (total - coalesce(sum(cap) FILTER (stops) OVER (), 0)))::DOUBLE
                  / (sum(weight) FILTER (NOT stops) OVER ())::DOUBLE END AS target FROM p),
seats AS (SELECT rank, total, target / (2 * j - 1) AS quotient, j FROM (
            SELECT rank, total, target, unnest(range(1, (target / {BLOCK_WORDS})::BIGINT + 100)) AS j FROM t)),
won AS (SELECT rank, count(*) AS q FROM (
          SELECT rank, total, row_number() OVER (ORDER BY quotient DESC, rank, j) AS place FROM seats)
        WHERE place <= round(total::DOUBLE / {BLOCK_WORDS}) GROUP BY rank),
b AS (SELECT t.*, least(coalesce(q, 0) * {BLOCK_WORDS}, source_size * {MAX_EPOCHS}) AS words,
             ceil(source_size / {BLOCK_WORDS}.0)::BIGINT AS line FROM t LEFT JOIN won ON t.rank = won.rank),
g AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes, CASE WHEN line > 0 THEN {BLOCK_WORDS}
             * (('0x' || substr(sha256('{SEED}|start|' || coalesce(source, 'null')), 1, 12))::BIGINT % line) ELSE 0 END AS lo FROM b),
h AS (SELECT *, lo + words - passes * source_size AS hi, source_size AS turn FROM g),
o AS (SELECT d.*, source_size, target, passes, lo, hi, turn, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY
             sha256('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target, (passes * size + greatest(least(hi, pos + size) - greatest(lo, pos), 0)
       + greatest(least(hi - turn, pos + size) - greatest(lo - turn, pos), 0))::BIGINT AS taken FROM o""")
def op4_mix_sources(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# the contract's rules: verdict, host, path
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@query("op6_url_filter", r"""
WITH u AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                      ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT page_id, first(h || p ORDER BY length(h || p) DESC) AS rule, first(v ORDER BY length(h || p) DESC) AS v
      FROM u JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN f ON u.page_id = f.page_id""")
def op6_url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark, URL_RULES))


@query("op7_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (
             SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op7_line_dedup(spark, sf_dir):
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of(), 256).alias("kept_sha256"))


@query("op2_near_dedup")
def op2_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


@query("op10_packing")
def op10_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_quality_rules")
def op8_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_quality_classifier")
def op9_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS id FROM p WHERE octet_length(b) >= 100 GROUP BY h)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, p.h AS payload_digest,
       CASE WHEN id IS NULL OR page_id = id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN id IS NOT NULL AND page_id != id THEN id END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h""")
def op5_warc(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_fill_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                  sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
x AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 AS plain FROM x),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf,
             CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN length(pre) END AS prefix_chars, CASE WHEN NOT plain THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""")
def op11_fill_middle(spark, sf_dir):
    return fill_in_middle(table(spark, sf_dir, "documents"))


@query("op12_conversation_repair", r"""
WITH RECURSIVE
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
w AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT)),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS way FROM k, crc),
h AS (SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE way WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM w WHERE way != 0),
o AS (SELECT *, row_number() OVER q - 1 AS i, lag(role) OVER q AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
             regexp_replace(text, '[ 	-
]+$', '') AS bare FROM h WINDOW q AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(bare, '[.!?]$') THEN 'truncated' ELSE 'none' END AS fault FROM o),
-- up to two inserts lead from state p to state m; then comes the row's own edit
ins(p, m, paid, e, roles) AS (VALUES ('', '', 0, '', []::VARCHAR[]), ('', 'u', 2, 'I', ['user:']), ('', 'a', 4, 'II', ['user:', 'assistant:']),
  ('s', 's', 0, '', []), ('s', 'u', 2, 'I', ['user:']), ('s', 'a', 4, 'II', ['user:', 'assistant:']),
  ('u', 'u', 0, '', []), ('u', 'a', 2, 'I', ['assistant:']), ('a', 'a', 0, '', []), ('a', 'u', 2, 'I', ['user:'])),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS rows FROM o
  UNION ALL
  SELECT conv_id, i, state, best.cost, best.audit, best.rows FROM (
    SELECT conv_id, i, state, min({'cost': cost, 'audit': audit, 'rows': rows}) AS best FROM (
      SELECT v.conv_id, v.i + 1 AS i, v.audit || ins.e || act AS audit,
             v.cost + ins.paid + CASE act WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN act != 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost,
             CASE act WHEN 'D' THEN m WHEN 'K' THEN substr(f.role, 1, 1) WHEN 'R' THEN CASE m WHEN 'u' THEN 'a' ELSE 'u' END END AS state,
             list_concat(list_concat(v.rows, ins.roles), CASE act WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text]
               ELSE [CASE m WHEN 'u' THEN 'assistant' ELSE 'user' END || ':' || f.text] END) AS rows
      FROM walk v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i JOIN ins ON ins.p = v.state, (VALUES ('D'), ('K'), ('R')) acts(act)
      WHERE act = 'D' OR (fault NOT IN ('blank', 'duplicate')
            AND (act = 'R' OR m || substr(f.role, 1, 1) IN ('s', 'u', 'su', 'ua', 'au') AND f.role != '')))
    GROUP BY conv_id, i, state)),
ends AS (SELECT conv_id, min({'cost': cost + CASE state WHEN 'u' THEN 2 WHEN 's' THEN 4 ELSE 0 END,
                              'audit': audit || CASE state WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END,
                              'rows': list_concat(rows, CASE state WHEN 'u' THEN ['assistant:'] WHEN 's' THEN ['user:', 'assistant:'] ELSE []::VARCHAR[] END)}) AS best
         FROM walk JOIN (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id) c USING (conv_id) WHERE i = n GROUP BY conv_id),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (i > 0 AND substr(before, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN sums USING (conv_id) LEFT JOIN ends USING (conv_id)""")
def op12_conversation_repair(spark, sf_dir):
    return repair_conversations(table(spark, sf_dir, "conversations"))


@query("op13_suffix_dedup")
def op13_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
