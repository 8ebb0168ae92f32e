"""One query per operator of this subpackage, over whole tables, and the SQL of those that SQL expresses."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontamination, license_scan, line_dedup, manifest, piece_bpe, quality_classifier, quality_rules, sharding, simhash, toxicity, url_filter, whitening
from weftgraph.llm.common import table
from weftgraph.llm.labelled import remainder, training_labels


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0
    model = quality_classifier.fit(docs, training_labels(table(spark, sf_dir, "labels"), "quality", ~held_out))
    return _predicted(quality_classifier.score(docs, model), held_out)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 4) == 2
    model = toxicity.fit(docs, training_labels(table(spark, sf_dir, "labels"), "toxic", ~held_out))
    return _predicted(toxicity.score(docs, model), held_out)


def _predicted(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


#: Rules and listed sites of the url query, as fixed values.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
LISTED_SITES = [f"{name}.example.{top}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED_SITES))).alias("url"))
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, listed)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: one directory for each source and language in it, and for each 64 ids below.

    Ids divisible by 1,024 are the licence files of a language's directory; of
    the others, those divisible by four that speak of a licence are licence files of theirs.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    notice = (F.col("doc_id") % 4 == 0) & F.coalesce(F.col("text").rlike(license_scan.CUE), F.lit(False))
    own = F.when(F.col("doc_id") % 1024 == 0, "LICENSE").when(notice, F.concat(part("bucket"), F.lit("/LICENSE"))).otherwise(F.concat(part("bucket"), F.lit("/"), part("doc_id"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").withColumn("bucket", F.floor(F.col("doc_id") / 64))
    files = files.select(F.col("doc_id").alias("id"), F.concat(part("source"), F.lit("/"), part("lang"), F.lit("/"), own).alias("path"), "text")
    return license_scan.scan(files).withColumnRenamed("id", "doc_id")


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_bpe.Model.load(spark, public_tokenizers.path("piece_bpe_32k.model"))
    coded = piece_bpe.encode(table(spark, sf_dir, "documents"), model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations past the range of longs, of which a table of this contract is not thought to have any, are null."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's checksum 3 divides are tampered with: their text's A-Z are lower-cased."""
    of = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, manifest.leaf(list((of | {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}).values())))
    rows = manifest.manifest(table(spark, sf_dir, "documents"), of, of["doc_id"], of["lang"], {"tampered": tampered})
    rows = rows.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf")))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_ring_sharding": op2_ring_sharding,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_toxicity": op4_toxicity,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filter": op9_url_filter,
    "op10_license_scan": op10_license_scan,
    "op11_piece_bpe": op11_piece_bpe,
    "op12_whitening": op12_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_MARKS_SQL = (
    f"list_distinct(list_concat(list_transform(regexp_extract_all(lower({{c}}), '{license_scan.VERSION}', 1), lambda v: CASE WHEN length(v) = 1 THEN v || '.0' ELSE v END), "
    + "list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(lower({{c}}), '{pattern}') THEN '{name}' END" for name, pattern in license_scan.MODIFIERS.items())
    + "], lambda x: x IS NOT NULL)))"
)
_NAMES_SQL = f"list_filter({license_scan.NAMES}, lambda x: list_contains(regexp_extract_all(lower({{c}}), '[a-z0-9]+([.][0-9]+)*'), x))"
_TEMPLATE_ROWS = ", ".join(f"('{k}', {i}, '{v.replace(chr(39), chr(39) * 2)}')" for k, texts in license_scan.TEMPLATES.items() for i, v in enumerate(texts))
_RULE_ROWS = ", ".join(f"('{a}', '{r}')" for a, r in URL_RULES)
_SITE_ROWS = ", ".join(f"('{u}')" for u in LISTED_SITES)

ORACLES: dict[str, str] = {
    "op8_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (
  SELECT doc_id, no, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS no, unnest(ls) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d))),
single AS (
  SELECT doc_id, line, no, length(array_to_string(w, '')) AS chars,
    (len(list_filter(w, lambda x: x = '|')) > 0 AND len(list_filter(w, lambda x: x = '|')) >= 0.3::DOUBLE * len(w))
    OR regexp_matches(line, '(?i)@BOILERPLATE@')
    OR (regexp_matches(line, '@MARKED@') AND len(list_filter(w, lambda x: regexp_matches(x, '@MARKED@'))) >= 0.3::DOUBLE * len(w))
    OR (len(w) >= 8 AND len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) >= 0.6::DOUBLE * (len(w) - 1))
    OR (len(list_filter(w, lambda x: regexp_matches(x, '(?i)@LINK@'))) >= 0.5::DOUBLE * len(w))
    OR (length(line) - length(regexp_replace(line, '[!-/:-@\[-`{-~]', '', 'g')) >= 0.5::DOUBLE * length(array_to_string(w, ''))) AS fault,
    len(w) <= 3 AND NOT regexp_matches(w[-1], '[.!?:;"'')\]}]$') AS item
  FROM l WHERE len(w) > 0),
runs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) - row_number() OVER (PARTITION BY doc_id, item ORDER BY no) AS run FROM single),
judged AS (SELECT doc_id, line, chars, fault OR (item AND count(*) OVER (PARTITION BY doc_id, item, run) >= 3) AS fault FROM runs),
by_line AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(chars) FILTER (fault), 0)::BIGINT AS lost_chars FROM judged GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], chr(1)) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 9)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
inside AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest(range(0, 8)) AS o) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(d.w)::BIGINT AS n_words, length(array_to_string(d.w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(b.n_dup_lines, 0) AS n_dup_lines, coalesce(i.n, 0) AS n_repeat_words, coalesce(b.lost_chars, 0) AS lost_chars
  FROM d LEFT JOIN by_line b ON d.doc_id = b.doc_id LEFT JOIN inside i ON d.doc_id = i.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars <= 0.6::DOUBLE * word_chars AS kept
FROM base
""",
    "op9_url_filter": rf"""
WITH rules(action, rule) AS (VALUES {_RULE_ROWS}), sites(site) AS (VALUES {_SITE_ROWS}),
p AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM (SELECT page_id, url, substring(url, strpos(url, '://') + 3) AS rest FROM pages)),
fit AS (
  SELECT p.page_id, p.url, max_by(struct_pack(a := action, r := rule), struct_pack(n := length(rule), r := rule)) AS best
  FROM p JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substring(rule, strpos(rule, '/')))
  GROUP BY p.page_id, p.url)
SELECT p.page_id, p.host, p.path, fit.best.r AS rule,
  EXISTS (SELECT 1 FROM sites WHERE p.host || '/' = site OR ends_with(p.host || '/', '.' || site)) AS listed,
  coalesce(fit.best.a, CASE WHEN EXISTS (SELECT 1 FROM sites WHERE p.host || '/' = site OR ends_with(p.host || '/', '.' || site)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit ON p.page_id = fit.page_id AND p.url IS NOT DISTINCT FROM fit.url
""",
    "op10_license_scan": rf"""
WITH templates(license, template, notice) AS (VALUES {_TEMPLATE_ROWS}),
f AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' AS lang_dir, doc_id // 64 AS b, regexp_matches(coalesce(text, ''), '{license_scan.CUE}') AS cued FROM documents),
files AS (
  SELECT doc_id, text, cued, CASE WHEN doc_id % 1024 = 0 THEN lang_dir || 'LICENSE' WHEN doc_id % 4 = 0 AND cued THEN lang_dir || b || '/LICENSE' ELSE lang_dir || b || '/' || doc_id || '.txt' END AS path
  FROM f),
named AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) = 'LICENSE' AS is_file, regexp_replace(path, '/[^/]*$', '') AS dir FROM files),
lined AS (
  SELECT doc_id, is_file, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{license_scan.COMMENT_MARK}', '')) AS ls FROM named WHERE cued OR is_file),
divided AS (SELECT *, string_split_regex(array_to_string(ls, chr(10)), '{license_scan.PARAGRAPH_END}') AS ps FROM lined),
blocks AS (
  SELECT * FROM (
    SELECT doc_id, unnest(list_distinct(list_concat(list_filter(ls, lambda x: regexp_matches(x, '{license_scan.CUE}')), list_filter(ps, lambda x: is_file OR regexp_matches(x, '{license_scan.CUE}'))))) AS block
    FROM divided) WHERE NOT regexp_matches(block, '{license_scan.NEGATED}')),
marked AS (SELECT doc_id, block, {_MARKS_SQL.format(c='block')} AS marks, {_NAMES_SQL.format(c='block')} AS named FROM blocks),
rules AS (SELECT license, template, {_MARKS_SQL.format(c='notice')} AS needs, {_NAMES_SQL.format(c='notice')} AS names FROM templates),
allowing AS (SELECT *, (SELECT flatten(list(o.needs)) FROM rules o WHERE o.license = r.license) AS allowed FROM rules r),
terms AS (SELECT doc_id, block, unnest(regexp_extract_all(lower(block), '[a-z0-9]+([.][0-9]+)*')) AS term FROM blocks),
tf AS (SELECT doc_id, block, term, count(*) AS tf FROM terms GROUP BY ALL),
tt AS (SELECT license, template, term, count(*) AS tf FROM (SELECT license, template, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+([.][0-9]+)*')) AS term FROM templates) GROUP BY ALL),
n AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id, block FROM tf)) + (SELECT count(*) FROM templates) AS n),
idf AS (SELECT term, ln((1 + (SELECT n FROM n))::DOUBLE / (1 + count(*))) + 1 AS idf FROM (SELECT term FROM tf UNION ALL SELECT term FROM tt) GROUP BY term),
w AS (SELECT doc_id, block, term, tf * idf AS w FROM tf JOIN idf USING (term)),
v AS (SELECT license, template, term, tf * idf AS v FROM tt JOIN idf USING (term)),
cosines AS (
  SELECT doc_id, license, template, max(round(dot / (sqrt(wn) * sqrt(vn)), 6)) AS cosine
  FROM (SELECT doc_id, block, license, template, sum(w * v) AS dot FROM w JOIN v USING (term) GROUP BY ALL)
  JOIN marked USING (doc_id, block) JOIN allowing USING (license, template)
  JOIN (SELECT doc_id, block, sum(w * w) AS wn FROM w GROUP BY ALL) USING (doc_id, block) JOIN (SELECT license, template, sum(v * v) AS vn FROM v GROUP BY ALL) USING (license, template)
  WHERE list_has_all(marks, needs) AND list_has_all(named, names) AND list_has_all(allowed, marks)
  GROUP BY ALL HAVING max(round(dot / (sqrt(wn) * sqrt(vn)), 6)) >= 0.6),
met AS (SELECT doc_id, license, max(cosine) AS cosine, round(sum(cosine), 4) AS total FROM cosines GROUP BY ALL),
best AS (SELECT doc_id, arg_min(cosine, struct_pack(t := -total, c := -cosine, l := license)) AS cosine, arg_min(license, struct_pack(t := -total, c := -cosine, l := license)) AS license FROM met GROUP BY doc_id),
tags AS (SELECT doc_id, regexp_replace(regexp_extract(text, '{license_scan.SPDX}', 1), '[ -]+$', '') AS tag FROM files),
own AS (SELECT named.doc_id, path, dir, is_file, CASE WHEN tag <> '' THEN tag ELSE license END AS license, CASE WHEN tag <> '' THEN 1.0 ELSE cosine END AS cosine FROM named LEFT JOIN best USING (doc_id) LEFT JOIN tags USING (doc_id)),
licensed AS (SELECT dir, arg_min(license, struct_pack(c := -cosine, l := license)) AS license FROM own WHERE is_file AND license IS NOT NULL GROUP BY dir),
near AS (
  SELECT own.doc_id, arg_max(licensed.license, length(licensed.dir)) AS license
  FROM own JOIN licensed ON own.dir = licensed.dir OR starts_with(own.dir, licensed.dir || '/') GROUP BY own.doc_id)
SELECT own.doc_id, own.path, coalesce(own.license, near.license) AS license, own.cosine,
  CASE WHEN own.license IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END WHEN near.license IS NOT NULL THEN 'inherited' END AS origin
FROM own LEFT JOIN near USING (doc_id)
""",
    "op6_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, i - 1 AS no, ls[i] AS line, doc_id::HUGEINT * 2147483648 + i - 1 AS ord
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
  WHERE regexp_matches(ls[i], '[^ \t-\r]')),
u AS (SELECT line, min(ord) AS first FROM l GROUP BY line),
p AS (
  SELECT line, first, unnest([
    'p' || (length(line) // 2) || left(line, length(line) // 2), 's' || (length(line) // 2) || right(line, length(line) // 2),
    'p' || ((length(line) - 1) // 2) || left(line, (length(line) - 1) // 2), 's' || ((length(line) - 1) // 2) || right(line, (length(line) - 1) // 2)]) AS k
  FROM u WHERE length(line) >= 16),
ends AS (SELECT line, first, unnest(['h' || left(line, 12), 't' || right(line, 12)]) AS k FROM u WHERE length(line) >= 25),
met AS (
  SELECT DISTINCT a.line AS al, b.line AS bl, greatest(length(a.line), length(b.line)) AS m, greatest(1, greatest(length(a.line), length(b.line)) // 25) AS s
  FROM (SELECT * FROM ends UNION ALL SELECT * FROM p) a JOIN (SELECT * FROM ends UNION ALL SELECT * FROM p) b ON a.k = b.k AND b.first < a.first
  WHERE abs(length(a.line) - length(b.line)) <= greatest(1, greatest(length(a.line), length(b.line)) // 25)),
near AS (
  SELECT DISTINCT al AS line FROM met
  WHERE levenshtein(al, bl) <= 4 * s AND len(list_filter(range(0, m - s + 1), lambda i: left(al, i) = left(bl, i) AND right(al, m - s - i) = right(bl, m - s - i))) > 0),
gone AS (
  SELECT l.doc_id, l.no FROM l JOIN u ON l.line = u.line LEFT JOIN near n ON l.line = n.line
  WHERE l.ord <> u.first OR n.line IS NOT NULL),
g AS (SELECT doc_id, list(no) AS nos FROM gone GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::INTEGER AS n_lines, coalesce(len(g.nos), 0)::INTEGER AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(d.ls) + 1), lambda i: g.nos IS NULL OR NOT list_contains(g.nos, i - 1)), lambda i: d.ls[i]), chr(10))) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
""",
}
for _name in ("BOILERPLATE", "MARKED", "LINK"):
    ORACLES["op8_quality_rules"] = ORACLES["op8_quality_rules"].replace(f"@{_name}@", getattr(quality_rules, _name).replace("'", "''"))


def _merkle_sql(levels: int = 8, group_levels: int = 4) -> str:
    """A manifest of up to 8 ** levels rows a language and 8 ** group_levels languages, level by level."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    zeros = ", ".join(["0::BIGINT"] * 8)
    ctes = [
        f"bytewise AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [{zeros}]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))",
        "summed AS (SELECT documents.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS crc FROM documents, bytewise)",
        f"leaves AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN crc % 3 = 0 THEN {leaf(lower)} END AS tampered FROM summed)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY lang) AS n FROM leaves)",
        "l0 AS (SELECT lang AS g, slot, leaf AS d, n FROM placed)",
        "r0 AS (SELECT doc_id, leaf, lang AS g, slot, coalesce(tampered, leaf) AS fold, '' AS proof FROM placed)",
    ]

    def tree(name: str, rows: str, levels: int) -> None:
        run = "(PARTITION BY g, slot // 8 ORDER BY slot ROWS BETWEEN "
        for k in range(levels):
            ctes.append(f"{name}s{k} AS (SELECT g, slot, n, coalesce(string_agg(d, '') OVER {run}UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lf, coalesce(string_agg(d, '') OVER {run}1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rt FROM {name}{k})")
            ctes.append(f"{name}{k + 1} AS (SELECT g, slot // 8 AS slot, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY slot)) ELSE any_value(d) END AS d, CASE WHEN max(n) > 1 THEN (max(n) + 7) // 8 ELSE 1 END AS n FROM {name}{k} GROUP BY g, slot // 8)")
            ctes.append(f"{rows}{k + 1} AS (SELECT r.* EXCLUDE (fold, proof), CASE WHEN s.n > 1 THEN sha256(lf || fold || rt) ELSE fold END AS fold, CASE WHEN s.n > 1 THEN proof || lf || rt ELSE proof END AS proof FROM {rows}{k} r JOIN {name}s{k} s ON r.g IS NOT DISTINCT FROM s.g AND r.slot // {8**k} = s.slot)")

    tree("l", "r", levels)
    ctes += [
        f"subs AS (SELECT g AS lang, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS slot, count(*) OVER () AS n FROM l{levels})",
        "t0 AS (SELECT 0 AS g, slot, d, n FROM subs)",
        f"q0 AS (SELECT r.doc_id, r.leaf, subs.d AS subroot, 0 AS g, subs.slot, r.fold, r.proof FROM r{levels} r JOIN subs ON r.g IS NOT DISTINCT FROM subs.lang)",
    ]
    tree("t", "q", group_levels)
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = d AS verified FROM q{group_levels}, t{group_levels}"


ORACLES["op13_merkle_manifest"] = _merkle_sql()
