"""Queries of the corpus operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from barloom.llm import bpe, exact_dedup, fill_middle, jaccard_join, licenses, minhash, mixing, quality_classifier, quality_rules, spelling, token_rollup, token_shards, url_filter
from barloom.llm.common import shared_folder, table, written

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op4_url_filters(spark, sf_dir):
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


OP4_SQL = r"""
WITH rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), parts AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), hits AS (
  SELECT n, first(rhost || rpath ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS rule,
         first(verdict ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN hits USING (n)
"""


def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

def op1_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"), licenses.known_licences(spark))


def _canonical_sql(text: str) -> str:
    """canonical() for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    c = f"regexp_replace({text}, {quote('(?m)' + licenses.COPYRIGHT_LINE)}, '', 'g')"
    c = f"concat(' ', regexp_replace({c}, {quote(licenses.MARKS)}, ' ', 'g'), ' ')"
    for pattern, to in licenses.SPELLINGS:
        c = f"regexp_replace({c}, {quote(pattern)}, {quote(to)}, 'g')"
    return f"trim({c}, ' ')"


OP1_SQL = f"""
WITH known(license_id, text) AS (VALUES {', '.join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in licenses.KNOWN.items())}),
     digests AS (SELECT sha256({_canonical_sql(_LOWER)}) AS canonical_sha256, min(license_id) AS license_id FROM known GROUP BY 1)
SELECT doc_id, canonical_sha256, license_id FROM (SELECT doc_id, sha256({_canonical_sql(_LOWER)}) AS canonical_sha256 FROM documents) LEFT JOIN digests USING (canonical_sha256)
"""

#: Pieces as two versions of one simple tokenizer count them: the second one knows letters beyond ASCII.
PIECES_1 = r"[A-Za-z]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9]"
PIECES_2 = r"[A-Za-z\x{80}-\x{10ffff}]+|[0-9]+|[\x21-/:-@\[-`{-~]"


def op2_token_counts(spark, sf_dir):
    """Totals after five batches: two tokenizers' counts, a replay, revised counts, a new version, deletions."""
    text = F.coalesce("text", F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    docs = table(spark, sf_dir, "documents").select("source", "lang", count(r"[^\x20\x09-\x0D]+").alias("words"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("breaks"), count(PIECES_1).alias("p1"), count(PIECES_2).alias("p2"))
    docs = written(docs)
    words, short = F.col("words"), docs.filter("words < 20")
    change = token_rollup.change
    batches = {
        "1-words": change(docs, "insert", "words-1", words),
        "2-pieces": change(docs, "insert", "pieces-1", F.col("p1")),
        "3-line-ends": change(docs, "revise", "words-1", words + F.col("breaks"), words),
        "4-pieces": change(docs, "delete", "pieces-1", F.col("p1")).union(change(docs, "insert", "pieces-2", F.col("p2"))),
        "5-short": change(short, "delete", "words-1", words + F.col("breaks")).union(change(short, "delete", "pieces-2", F.col("p2"))),
    }
    rollup = token_rollup.TokenRollup(spark, shared_folder(spark))
    for batch in [*batches, "2-pieces", "5-short"]:  # the last two are replays
        rollup.commit(batch, batches[batch])
    return rollup.totals(list(batches))


OP2_SQL = f"""
WITH d AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
         length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS breaks,
         len(regexp_extract_all(coalesce(text, ''), '{PIECES_2}')) AS p2
  FROM documents
)
SELECT source, lang, 'words-1' AS tokenizer, count(*) FILTER (WHERE words >= 20) AS documents, coalesce(sum(words + breaks) FILTER (WHERE words >= 20), 0)::BIGINT AS tokens FROM d GROUP BY source, lang
UNION ALL SELECT source, lang, 'pieces-1', 0, 0 FROM d GROUP BY source, lang
UNION ALL SELECT source, lang, 'pieces-2', count(*) FILTER (WHERE words >= 20), coalesce(sum(p2) FILTER (WHERE words >= 20), 0)::BIGINT FROM d GROUP BY source, lang
"""


def op3_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), quality_rules.trusted_ids(table(spark, sf_dir, "labels")))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), tok AS (
  SELECT n, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), b) ORDER BY b) AS t FROM range(256) r(b)
), distinct_words AS (
  SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM tok)
), hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: (16 * (instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1)::BIGINT),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM distinct_words, crc_table
), grams AS (
  SELECT n, doc_id, i, h, lead(h) OVER o AS after,
         CASE WHEN lead(word, 7) OVER o IS NOT NULL THEN concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) END AS win
  FROM tok JOIN hashed USING (word) WINDOW o AS (PARTITION BY n ORDER BY i)
), marked AS (
  SELECT n, i, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY n, win) > 1 THEN 1 ELSE 0 END AS twice FROM grams
), covered AS (
  SELECT n, max(twice) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM marked
), repeats AS (
  SELECT n, sum(c)::BIGINT AS n_repeat_words FROM covered GROUP BY n
), buckets AS (
  SELECT n, doc_id, h % 65521 AS b FROM grams
  UNION ALL SELECT n, doc_id, 65521 + (h * 1000003 + after) % 65521 FROM grams WHERE after IS NOT NULL
), counts AS (
  SELECT b, count(*) AS raw, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good FROM buckets GROUP BY b
), weights AS (
  SELECT b, round(ln((good + 1.0::DOUBLE) / (raw::DOUBLE * (SELECT sum(good) FROM counts)::DOUBLE / (SELECT sum(raw) FROM counts)::DOUBLE + 1.0::DOUBLE)) * 1000000.0::DOUBLE)::BIGINT AS weight FROM counts
), totals AS (
  SELECT n, sum(weight)::BIGINT AS total FROM buckets JOIN weights USING (b) GROUP BY n
), stats AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, total
  FROM d LEFT JOIN repeats USING (n) LEFT JOIN totals USING (n)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND total >= -300000 * (2 * n_words - 1) AS kept,
       total / (2 * n_words - 1)::DOUBLE / 1000000.0::DOUBLE AS score
FROM stats
"""

def op7_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.placed(docs, mixing.root_targets(docs))


OP7_SQL = f"""
WITH RECURSIVE shares AS (
  SELECT coalesce(source, chr(0)) AS key, floor(sqrt(count(*)))::BIGINT AS share FROM documents GROUP BY 1
), one AS (
  SELECT list({{'k': key, 'e': share}} ORDER BY key) AS al, sum(share)::BIGINT AS p FROM shares
), sim AS (
  SELECT -1::BIGINT AS slot, list_transform(al, lambda s: 0::BIGINT) AS done, NULL::BIGINT AS i FROM one
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda d, k: d + CASE WHEN k = c.i THEN 1 ELSE 0 END), c.i
  FROM (
    SELECT slot, done, p, list_sort(list_filter(list_transform(range(1, len(al) + 1), lambda k: CASE WHEN done[k] < al[k].e AND (done[k] * p) // al[k].e <= slot + 1 THEN {{'d': ((done[k] + 1) * p + al[k].e - 1) // al[k].e, 'i': k}} END), lambda x: x IS NOT NULL))[1] AS c
    FROM sim, one
  ) WHERE slot + 1 < p
), turns AS (
  SELECT al[i].k AS key, al[i].e AS share, p, slot, row_number() OVER (PARTITION BY i ORDER BY slot) - 1 AS turn FROM sim, one WHERE i IS NOT NULL
), ranked AS (
  SELECT doc_id, source, coalesce(source, chr(0)) AS key, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS r FROM documents
), blocks AS (
  SELECT *, r // {mixing.BLOCK_DOCS} AS block, r % {mixing.BLOCK_DOCS} AS place FROM ranked
)
SELECT doc_id, source, block, (block // share) * p + (turn * p) // share AS release, (block // share) * p + ((turn + 1) * p + share - 1) // share AS deadline, (block // share) * p + slot AS slot, place
FROM blocks JOIN turns USING (key) WHERE turn = block % share
"""


def op8_token_shards(spark, sf_dir):
    folder = shared_folder(spark)
    token_shards.write_shards(table(spark, sf_dir, "documents"), folder)
    return token_shards.read_documents(spark, folder)


def op9_quality_classifier(spark, sf_dir):
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark, sf_dir):
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


#: Pairs by what is left of words without one code point: a replaced one leaves the same at the same place, an inserted one the other word.
OP11_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
), counted AS (
  SELECT id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY id, run
), crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), b) ORDER BY b) AS t FROM range(256) r(b)
), spelt AS (
  SELECT id, run, c, hex(encode(id || ':' || run)) AS x FROM counted
), hashed AS (
  SELECT id, run, c, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: (16 * (instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1)::BIGINT),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM spelt, crc_table
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(c)::BIGINT AS n FROM hashed GROUP BY 1
), w AS (
  SELECT word, n FROM words WHERE length(word) >= 7 AND n >= 2
), cuts AS (
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)
), near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN w ON c.cut = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN w ON c.cut = w.word
), best AS (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY w.n DESC, other) AS form, max(w.n) AS form_n FROM near JOIN w ON w.word = other GROUP BY near.word
), told AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM w LEFT JOIN best ON best.word = w.word
), chain AS (
  SELECT word, word AS root, form AS next FROM told
  UNION ALL SELECT chain.word, chain.next, told.form FROM chain JOIN told ON told.word = chain.next
)
SELECT told.word, n, n_near, form, form_n, root FROM told JOIN chain ON chain.word = told.word AND chain.next IS NULL
"""

def op12_fill_in_middle(spark, sf_dir):
    return fill_middle.digests(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))


#: What is restored is the text itself, which the SQL takes as it is.
OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), h AS (
  SELECT doc_id, text, n, list_transform(range(4), lambda k: list_reduce(list_transform(range(8), lambda i: (instr('0123456789abcdef', substr(digest, 8 * k + i + 1, 1)) - 1)::BIGINT), lambda a, b: 16 * a + b)) AS h FROM d
), f AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi
  FROM h
), p AS (
  SELECT *, substring(text, 1, lo) AS prefix, substring(text, lo + 1, hi - lo) AS middle, substring(text, hi + 1) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

def op13_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_quality_rules, op4_url_filters, op5_jaccard_join, op6_exact_dedup, op7_mixing, op8_token_shards, op9_quality_classifier, op10_bpe, op11_spelling_variants, op12_fill_in_middle, op13_minhash)} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = {"op1_license_scan": OP1_SQL, "op2_token_counts": OP2_SQL, "op3_quality_rules": OP3_SQL, "op4_url_filters": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op7_mixing": OP7_SQL, "op11_spelling_variants": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
