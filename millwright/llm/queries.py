"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import align, chat, exact_dedup, jaccard, langid, lexical, licenses, mixing, packing, quality, sharding, simhash, tokenbin

PROBE = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).drop("rid")


def op3_sharding(spark, sf_dir):
    return sharding.shard_digest(sharding.write_shards(_table(spark, sf_dir, "documents")))


def op4_license_scan(spark, sf_dir):
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).withColumn("licenses", F.array_join("licenses", ","))


def op5_quality_rules(spark, sf_dir):
    judged = quality.judge_documents(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")


def op6_chat_formatting(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])).alias("t"))
    probe = probe.select("conv_id", "t.turn", "t.role", F.lit(PROBE).alias("text"))
    return chat.read_back(chat.format_log(chat.events_of_turns(turns.unionByName(probe), revised=True)))


def op7_source_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"), every_source=True)


def op8_simhash_dedup(spark, sf_dir):
    return simhash.near_groups(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_token_planes(spark, sf_dir):
    return tokenbin.read_digests(tokenbin.write_tokens(_table(spark, sf_dir, "documents")))


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark, sf_dir):
    return align.align_documents(_table(spark, sf_dir, "documents")).drop("rid")


def op12_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents")).drop("rid")


def op13_lexical_search(spark, sf_dir):
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries():
    return {f.__name__: f for f in (op1_language_id, op2_exact_dedup, op3_sharding, op4_license_scan, op5_quality_rules, op6_chat_formatting, op7_source_mixing, op8_simhash_dedup, op9_token_planes, op10_best_fit_packing, op11_token_alignment, op12_jaccard_join, op13_lexical_search)}


def _escaped_length() -> str:
    """Characters that escaping adds to a turn's text."""
    out = "replace(text, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return f"length({out})"


def _quality_sql() -> str:
    separators = ", ".join(f"'{x}'" for x in quality.SEPARATORS)
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
              FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
        n AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM w GROUP BY 1),
        g AS (SELECT doc_id, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS k, lead(w, 4) OVER o AS last
              FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g WHERE last IS NOT NULL) WHERE c > 1),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY 1),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)),
        m AS (SELECT doc_id, line, no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw,
                     length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS solid,
                     length(regexp_replace(line, '[^#$%&*+/<=>@\[\\\]^_`{{|}}~]', '', 'g')) AS marks FROM l),
        f AS (SELECT *, (len(lw) >= 4 AND marks >= {quality.MARKS} * greatest(solid, 1))
                     OR (len(lw) >= 4 AND len(list_filter(lw, lambda x: x IN ({separators}))) >= {quality.BARS} * len(lw))
                     OR (len(lw) BETWEEN 1 AND {quality.FURNITURE_WORDS} AND regexp_matches(line, '{quality.FURNITURE}')) AS fails FROM m),
        u AS (SELECT doc_id, count(*) FILTER (WHERE fails) AS n_lines_removed, sum(CASE WHEN fails THEN solid ELSE 0 END) / greatest(sum(solid), 1) AS lost FROM f GROUP BY 1),
        q AS (SELECT doc_id, count(*) AS n_dup_lines FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY no) AS k FROM m WHERE len(lw) > 0) WHERE k > 1 GROUP BY 1),
        s AS (SELECT doc_id, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
        a AS (SELECT s.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                     coalesce(n_repeat_words, 0) AS n_repeat_words, lost, n_lines_removed
              FROM s LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN q USING (doc_id)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND lost <= {quality.MAX_LOST} AS kept, n_lines_removed FROM b"""


def _license_sql() -> str:
    texts = ", ".join("('{}', '{}')".format(name, t.replace("'", "''")) for name, ts in licenses.TEMPLATES.items() for t in ts)
    words = lambda c: f"string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    pairs = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    t = licenses.THRESHOLD
    return f"""
        WITH k AS (SELECT name, {pairs("w")} AS b FROM (SELECT name, {words("t")} AS w FROM (VALUES {texts}) AS v(name, t))),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
        n AS (SELECT *, regexp_matches(lower(line), '[\\p{{L}}\\p{{N}}]') AS solid FROM l),
        g AS (SELECT *, sum(CASE WHEN solid THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY no) AS run FROM n),
        p AS (SELECT doc_id, 'paragraph' AS unit, min(no) AS no, string_agg(line, ' ' ORDER BY no) AS body FROM g WHERE solid GROUP BY doc_id, run HAVING count(*) > 1),
        x AS (SELECT doc_id, 'text' AS unit, 0 AS no, string_agg(line, ' ' ORDER BY no) AS body FROM n GROUP BY doc_id HAVING count(*) > 1 AND NOT bool_and(solid)),
        u AS (SELECT doc_id, 'line' AS unit, no, line AS body FROM n WHERE solid UNION ALL SELECT * FROM p UNION ALL SELECT * FROM x),
        b AS (SELECT doc_id, unit, no, {pairs("w")} AS b FROM (SELECT doc_id, unit, no, {words("body")} AS w FROM u)),
        d AS (SELECT doc_id, unit, no, name, 2 * len(list_intersect(b.b, k.b)) / (len(b.b) + len(k.b)) AS dice
              FROM b JOIN k ON len(b.b) BETWEEN {t / (2 - t)} * len(k.b) AND {(2 - t) / t} * len(k.b)),
        f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name, unit, no) AS r FROM d WHERE dice >= {t}),
        s AS (SELECT doc_id, list_sort(list(DISTINCT name)) AS licenses FROM f GROUP BY 1)
        SELECT doc_id, name AS license, round(dice, 6) AS dice, unit, CAST(no AS BIGINT) AS line_no, array_to_string(coalesce(licenses, []), ',') AS licenses
        FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT * FROM f WHERE r = 1) USING (doc_id) LEFT JOIN s USING (doc_id)"""


def _jaccard_sql() -> str:
    later = " || ".join(f"coalesce(' ' || lead(w, {k}) OVER o, '')" for k in range(1, jaccard.WIDTH))
    return rf"""
        WITH RECURSIVE w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n
          FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{lexical.UPPER}', '{lexical.LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
        g AS (SELECT doc_id, w || {later} AS s, i, n FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        s AS (SELECT DISTINCT doc_id, s FROM g WHERE i = 1 OR i <= n - {jaccard.WIDTH - 1}),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= {jaccard.PERCENT} * (x.n + y.n - k)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(doc_id, m), doc_id) AS component_id
        FROM (SELECT doc_id FROM documents) LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) USING (doc_id)"""


def _lexical_sql() -> str:
    terms = f"unnest(regexp_extract_all(translate(text, '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.TERM}')) AS term"
    return f"""
        WITH t AS (SELECT doc_id, {terms} FROM documents),
        f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
        s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, docs),
        m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // terms AS m FROM n, s),
        q AS (SELECT item_id, {terms} FROM benchmark),
        c AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
        r AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
              FROM c JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= {lexical.TOP}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_jaccard_join": _jaccard_sql(),
        "op13_lexical_search": _lexical_sql(),
        "op4_license_scan": _license_sql(),
        "op5_quality_rules": _quality_sql(),
        "op2_exact_dedup": r"""
            WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                              regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                   row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id ASC NULLS LAST)""",
        "op6_chat_formatting": f"""
            WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text))) AS turns_sha256,
                   CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
                   sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, md5(text))) AS loss_sha256,
                   CAST(sum({len(chat.START + chat.END) + 1} + length(url_encode(role)) + {_escaped_length()}) AS BIGINT) AS formatted_chars
            FROM t GROUP BY conv_id""",
    }
