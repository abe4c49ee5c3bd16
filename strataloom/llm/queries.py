"""The training-data queries, each over the whole of its table.

Other columns than those that a query names are ignored, and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf_lang, kneser_ney, minhash, nbest, packing, quality, secrets, tiff, url_filter, vbyte


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the samples of a TIFF page and back: nulls are empty texts, repeated rows give repeated results."""
    return tiff.digests(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages learned from two thirds of the labelled documents, predicted for all; `und` for null texts and those without a letter."""
    docs = _table(spark, sf_dir, "documents")
    crf = crf_lang.train(docs.where(~crf_lang.held_out()))
    out = crf_lang.predict(docs, crf)
    return out.select("doc_id", crf_lang.held_out().alias("held_out"), "lang_pred", "score", "lettered_words", "switches")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents of similarity 0.85 or more over three-word shingles; null and blank texts are linked with nothing."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, threshold=0.85)


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in sequences of 1024; a null text is its end id alone."""
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op5_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of each document; scores and digests as text. A null text has no pieces."""
    out = nbest.encode(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    scores = F.array_join(F.transform("scores", lambda x: F.round(x, 4).cast("string")), ",")
    said = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("nbest_pieces", "nbest_crc32")}
    return out.withColumns({"scores": scores, **said})


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of each document; a null text has counts of 0 and fails the base rules."""
    return quality.report(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids through shard files; a null text is its end id alone."""
    return vbyte.round_trip(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in each document; a null text has none."""
    return secrets.report(_table(spark, sf_dir, "documents"))


#: The contract's rules for the query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of each page; a null url has an empty host and path."""
    model = url_filter.train(url_filter.default_labels(spark))
    return url_filter.judge(_table(spark, sf_dir, "pages"), model, URL_RULES)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's hosts, paths and rules, which SQL can express."""
    return url_filter.ruled(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document under a model of six sevenths of them; a null text is its end alone."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model = kneser_ney.train(docs.where(~held_out))
    return kneser_ney.score(docs, model, held_out=held_out)


QUERIES = {
    "op1_tiff": op1_tiff,
    "op2_language_id": op2_language_id,
    "op3_near_dedup": op3_near_dedup,
    "op4_packing": op4_packing,
    "op5_nbest": op5_nbest,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_files": op7_token_files,
    "op8_secret_scan": op8_secret_scan,
    "op10_url_filter": op10_url_filter,
    "op9_lm_score": op9_lm_score,
    "url_rules": url_rules,
}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: (metric, percentile, spread) of the rules.
_RATES = [("symbol_rate", 75, 3), ("dup_rate", 99, 1), ("repeat_rate", 99, 1), ("mean_word", 75, 6)]
_TOP = "CASE WHEN b < 128 THEN b ELSE ((b - 64 * ((b - 64) // 64) + 1) << ((b - 64) // 64)::INT) - 1 END"
_BOTTOM = "CASE WHEN b < 128 THEN b ELSE (b - 64 * ((b - 64) // 64)) << ((b - 64) // 64)::INT END"


def _quantiles(keys: str, tag: str) -> str:
    by = f"{keys}, metric, level"
    return f"""
{tag}_sum AS (SELECT {by}, b, sum(n) AS n FROM sketch GROUP BY {by}, b),
{tag}_cum AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY b) AS seen, sum(n) OVER (PARTITION BY {by}) AS total FROM {tag}_sum),
{tag} AS (SELECT {by}, max(total) AS n, min({_BOTTOM}) FILTER (100 * seen >= (100 - level) * total) AS low, min({_TOP}) FILTER (100 * seen >= level * total) AS high FROM {tag}_cum GROUP BY {by})"""


_QUALITY_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
keyed AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS k FROM win),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
base AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN ln ON ln.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  coalesce(10000 * greatest(n_symbols - 1, 0) // nullif(word_chars, 0), 0) AS symbol_rate, coalesce(10000 * greatest(n_dup_lines - 1, 0) // nullif(n_lines, 0), 0) AS dup_rate,
  coalesce(10000 * greatest(n_repeat_words - 10, 0) // nullif(n_words, 0), 0) AS repeat_rate, coalesce(100 * word_chars // nullif(n_words, 0), 0) AS mean_word FROM base),
long AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{m}' AS metric, {q} AS level, {k} AS spread, {m}::BIGINT AS v FROM f" for m, q, k in _RATES)}),
sketch AS (SELECT lang, source, 1 AS one, metric, level, CASE WHEN v < 128 THEN v ELSE (v >> (length(bin(v)) - 7)::INT) + 64 * (length(bin(v)) - 7) END AS b,
  sum((NOT base_failed)::INT) AS n FROM long GROUP BY ALL),
{_quantiles("lang, source", "fine")}, {_quantiles("lang", "coarse")}, {_quantiles("one", "whole")},
bad AS (SELECT DISTINCT doc_id FROM long l
  JOIN fine a ON a.lang IS NOT DISTINCT FROM l.lang AND a.source IS NOT DISTINCT FROM l.source AND a.metric = l.metric
  JOIN coarse c ON c.lang IS NOT DISTINCT FROM l.lang AND c.metric = l.metric JOIN whole g ON g.metric = l.metric
  WHERE v > CASE WHEN a.n >= 100 THEN a.high + spread * (a.high - a.low) WHEN c.n >= 100 THEN c.high + spread * (c.high - c.low)
    ELSE g.high + spread * (g.high - g.low) END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f
"""

_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"({_ANY_CASE})[\"\'\']?\\x20*[:=]\\x20*[\"\'\']?([A-Za-z0-9+/_.=-]+)"
_KIND_SQL = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}", "secret": "[A-Za-z0-9+/]{40,}=?", "endpoint": "https?://[^\\x00-\\x20\"\'\'<>]+"}
_SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS ({" UNION ALL ".join(f"SELECT doc_id, {k} AS kind, regexp_split_to_array(text, '{x}') AS gaps, regexp_extract_all(text, '{x}', 0) AS found, regexp_extract_all(text, '{x}', {2 if k == 0 else 0}) AS part FROM d WHERE regexp_matches(text, '{x}')" for k, x in enumerate(_KIND_SQL.values()))}),
each AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM c),
placed AS (SELECT doc_id, kind, part[i] AS part, length(found[i]) AS n,
  coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start FROM each),
span AS (SELECT doc_id, kind, start::BIGINT AS start, (start + n)::BIGINT AS stop FROM placed
  WHERE CASE kind WHEN 0 THEN length(part) >= 6 WHEN 3 THEN n = 40 AND NOT contains(part, '=') AND regexp_matches(part, '[0-9]') AND regexp_matches(part, '[A-Za-z]') ELSE true END),
kept AS (SELECT * FROM span a WHERE kind < 3 OR EXISTS (SELECT 1 FROM span b WHERE b.doc_id = a.doc_id AND b.start - a.stop <= 400 AND a.start - b.stop <= 400
  AND CASE a.kind WHEN 3 THEN b.kind IN (1, 4) ELSE b.kind IN (0, 1, 3) END)),
said AS (SELECT *, ['assign', 'access', 'hex', 'secret', 'endpoint'][kind + 1] || ':' || start || ':' || stop AS x FROM kept),
agg AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(x, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY start, kind) AS spans FROM said GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg ON agg.doc_id = d.doc_id
"""

#: Longer rules first.
_RULES_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT * FROM (VALUES ('block', 'example.org', '/en/1'), ('block', 'example.org', '/es/'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'), ('allow', 'org', '/')) AS t(verdict, host, path))
SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict AS rule_verdict
FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) = 1
"""

ORACLES: dict[str, str] = {
    "url_rules": _RULES_SQL,
    "op8_secret_scan": _SECRETS_SQL,
    "op6_quality_rules": _QUALITY_SQL,
    "op3_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWERED)} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, l.b FROM reach JOIN both_ways l ON l.a = reach.r),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
}
