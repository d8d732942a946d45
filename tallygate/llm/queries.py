"""The registered queries of the text operators over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontamination, embedding_dedup, jaccard_join, licences, lm_scoring, packing, periodic_runs, pii, quality, quality_rules, substring_dedup, url_filter
from .shared import Table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The byte-level vocabulary's file, which the executors find under the same path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), size=2048, end=1)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = url_filter.rules(block=["com/en/", "example.net/de/8", "org/es/"], allow=["example.com/en/7", "net/de/"])
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), listed).select("page_id", "host", "path", "rule", "verdict")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), at=0.7)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, threshold=(85, 100))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), "v2")
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.mask("base")).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def licence_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in a table with many copies: of nine documents in a row, seven have become a known text under a holder's
    line of their own, in capitals or spaced out, one has become such a text with a word more, and one has its own text.
    """
    own = table(spark, sf_dir, "documents")
    k, count = F.pmod("doc_id", F.lit(len(licences.KNOWN) + 2)).cast("int"), len(licences.KNOWN)
    text = F.get(F.array(*(F.lit(t) for _, t in licences.KNOWN)), F.when(k < count, k).otherwise(0))
    body = F.when(F.col("doc_id") % 2 == 0, F.translate(text, licences.LOWER, licences.UPPER)).otherwise(F.replace(text, F.lit(" "), F.lit(" - ")))
    holder = F.concat(F.lit("Copyright (c) 2021 "), F.coalesce("source", F.lit("someone")), F.lit("\n\n"))
    copied = F.when(k < count, F.concat(holder, body)).when(k == count, F.concat(holder, body, F.lit("\nmore"))).otherwise(F.col("text"))
    written = Table(own.select("doc_id", copied.alias("text")), "licences")
    return licences.scan_licences(written.df)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=13)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.repeated_stretch(table(spark, sf_dir, "documents")), least=24, power=3)
    top = found.withColumn("top", periodic_runs.best_run())
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        digest(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"), digest(F.col("kept")).alias("collapsed_sha256"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.turns(table(spark, sf_dir, "conversations"))
    return conversation_repair.report(rows, conversation_repair.damage(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_url_filter, op3_personal_data, op4_quality, op5_lm_score, op6_jaccard_join, op7_decontamination,
        op8_quality_rules, op9_licences, licence_copies, op10_substring_dedup, op11_embedding_dedup, op12_periodic_runs, op13_conversation_repair,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _shingles(key: str, name: str, k: int) -> str:
    """SQL for the distinct (key, g) of a table's k-word shingles."""
    return f"""
        SELECT DISTINCT {key}, array_to_string(w[i : i + {k - 1}], ' ') AS g
        FROM (SELECT {key}, {_words(_LOWER)} AS w FROM {name}) t, unnest(range(1, greatest(len(w) - {k - 2}, 2))) u(i)
        WHERE len(w) > 0"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The SQL's rule for lines that name a holder.
_COPYRIGHT = r"(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*"


def _canonical(text: str) -> str:
    """SQL for the canonical form of a licence text."""
    x = f"translate(coalesce({text}, ''), '{licences.UPPER}', '{licences.LOWER}')"
    x = f"regexp_replace({x}, {_quote(_COPYRIGHT)}, chr(10), 'g')"
    x = f"trim(regexp_replace(translate({x}, {_quote(licences.PUNCTUATION)}, repeat(' ', {len(licences.PUNCTUATION)})), ' +', ' ', 'g'))"
    for a, b in licences.SPELLINGS:
        x = f"regexp_replace({x}, '\\b{a}(s?)\\b', '{b}\\1', 'g')"
    return x


def _licence_sql(docs: str) -> str:
    known = ", ".join(f"({_quote(i)}, {_quote(t)})" for i, t in licences.KNOWN)
    return f"""
        WITH k AS (SELECT sha256({_canonical("t")}) AS d, min(id) AS license_id FROM (VALUES {known}) v(id, t) GROUP BY d),
        x AS (SELECT doc_id, sha256({_canonical("text")}) AS digest FROM ({docs}) docs)
        SELECT doc_id, digest, license_id FROM x LEFT JOIN k ON digest = d"""


_COPY = f"CASE doc_id % {len(licences.KNOWN) + 2} {' '.join(f'WHEN {i} THEN {_quote(t)}' for i, (_, t) in enumerate(licences.KNOWN))} WHEN {len(licences.KNOWN)} THEN {_quote(licences.KNOWN[0][1])} END"
#: SQL for the table of copies: a known text under a holder's line, in capitals or spaced out, or with a word more, or the document.
_COPIES = f"""SELECT doc_id, CASE WHEN t IS NULL THEN text ELSE 'Copyright (c) 2021 ' || coalesce(source, 'someone') || repeat(chr(10), 2)
        || CASE WHEN doc_id % 2 = 0 THEN translate(t, '{licences.LOWER}', '{licences.UPPER}') ELSE replace(t, ' ', ' - ') END
        || CASE WHEN doc_id % {len(licences.KNOWN) + 2} = {len(licences.KNOWN)} THEN chr(10) || 'more' ELSE '' END END AS text
    FROM (SELECT *, {_COPY} AS t FROM documents) c"""
_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(quality_rules.RULES))
_HELD = lambda m: f"(failed & {m}) <> 0"



#: SQL for the table of CRC-32, by its rule.
_CRC_TABLE = """SELECT list(c ORDER BY n) AS crc FROM (SELECT n, list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) t(n)) u"""


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text, a byte at a time by the column ``crc`` of the table above."""
    chars = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {chars}), lambda c, b: xor(c // 256, crc[xor(c, b) % 256 + 1])), 4294967295)"


def _repair_sql() -> str:
    """SQL for op13: a recursion over the turns, whose four paths are texts of nine digits of cost and the audit."""
    add = lambda x, cost, letter: f"lpad((substr({x}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || {letter}"
    live = lambda x: f"CASE WHEN NOT dead THEN {x} END"
    write = lambda x, i: live(add(x, f"t + CASE WHEN i = '{i}' THEN 0 ELSE 1 END", f"CASE WHEN i = '{i}' THEN 'K' ELSE 'R' END"))
    inserted = lambda rows: f"SELECT *, least(a, {add('u', 5, chr(39) + 'I' + chr(39))}) AS b FROM (SELECT * REPLACE (least(u, {add('least(e, s, a)', 5, chr(39) + 'I' + chr(39))}) AS u) FROM ({rows}) v) w"
    gone = lambda x: add(x, 2, "'D'")
    return f"""
        WITH RECURSIVE f AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, ({_CRC_TABLE}) q),
        d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM f, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) c(j)),
        o AS (SELECT *, substr(role, 1, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again,
            regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS open FROM d),
        g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS p FROM o),
        x AS MATERIALIZED (SELECT conv_id, turn, role, text, i, p, blank, again AND NOT blank AS again, open AND NOT blank AND NOT again AS open, blank OR again AS dead,
            CASE WHEN open THEN 5 ELSE 0 END AS t, lag(i) OVER (PARTITION BY conv_id ORDER BY p) || i NOT IN ('su', 'ua', 'au') AS illegal FROM g),
        n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
            count(*) FILTER (open) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n FROM x GROUP BY conv_id),
        r AS (SELECT conv_id, 0::BIGINT AS p, '000000000' AS e, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM n
            UNION ALL SELECT conv_id, p, {gone("e")}, least({gone("s")}, {live(f"CASE WHEN i = 's' THEN {add('e', 't', chr(39) + 'K' + chr(39))} END")}),
                least({gone("u")}, {write("least(e, s, b)", "u")}), least({gone("b")}, {write("u", "a")})
            FROM ({inserted("SELECT x.conv_id, x.p, x.i, x.dead, x.t, r.e, r.s, r.u, r.a FROM r JOIN x ON x.conv_id IS NOT DISTINCT FROM r.conv_id AND x.p = r.p + 1")}) y),
        z AS MATERIALIZED (SELECT conv_id, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit
            FROM (SELECT conv_id, least(e, b) AS best FROM ({inserted("SELECT r.* FROM r JOIN n ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.p = n.n")}) y) w),
        l AS (SELECT conv_id, k, audit[k] AS edit, length(replace(audit[:k], 'I', '')) AS p, length(replace(audit[:k], 'D', '')) AS j FROM z, unnest(range(1, length(audit) + 1)) q(k)),
        m AS (SELECT l.conv_id, l.k, l.edit, l.j, x.role, x.text, max(CASE WHEN l.j = 1 AND edit = 'K' AND x.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system
            FROM l LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM l.conv_id AND x.p = l.p AND l.edit <> 'I' WHERE l.edit <> 'D'),
        h AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS whole FROM m GROUP BY conv_id)
        SELECT c.conv_id, {", ".join(f"coalesce({v}, 0)::BIGINT AS {v}" for v in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))},
            coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
            LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE: dict[str, str] = {
    "op11_embedding_dedup": """
        WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        reach(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT y, root FROM reach JOIN link ON x = reach.vec_id),
        least AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id),
        n AS (SELECT x AS vec_id, count(*) AS n FROM link GROUP BY x)
        SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op13_conversation_repair": _repair_sql(),
    "op8_quality_rules": f"""
        WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS s, {_words("coalesce(text, '')")} AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
        v AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM t, unnest(range(1, len(w) - 3)) u(i)),
        r AS (SELECT doc_id, g FROM v GROUP BY ALL HAVING count(*) > 1),
        c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM v JOIN r USING (doc_id, g), unnest(range(0, 5)) u(j) GROUP BY doc_id),
        m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
            (length(s) - length(translate(s, '{quality_rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
            (length(s) - length(translate(s, '{licences.UPPER}', '')))::BIGINT AS n_upper,
            len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
            FROM t LEFT JOIN c USING (doc_id)),
        f AS (SELECT *, ({_BITS})::BIGINT AS failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            {_HELD(quality_rules.mask("base"))} AS base_failed, NOT {_HELD(quality_rules.mask("v2"))} AS kept, failed FROM f""",
    "op9_licences": _licence_sql("SELECT doc_id, text FROM documents"),
    "licence_copies": _licence_sql(_COPIES),
    "op6_jaccard_join": f"""
        WITH RECURSIVE s AS MATERIALIZED ({_shingles("doc_id", "documents", 4)}),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
        reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, root FROM reach JOIN link ON x = reach.doc_id)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.root AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) r USING (doc_id)""",
    "op7_decontamination": f"""
        WITH d AS ({_shingles("doc_id", "documents", 5)}), b AS ({_shingles("item_id", "benchmark", 5)}),
        n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
        p AS (SELECT doc_id, item_id, count(*) AS k FROM d JOIN b USING (g) GROUP BY ALL)
        SELECT doc_id, item_id, n::BIGINT AS n_item_shingles, k::BIGINT AS n_shared FROM p JOIN n USING (item_id) WHERE 100 * k >= 80 * n""",
    "op10_substring_dedup": f"""
        WITH w AS MATERIALIZED (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
        v AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM w, unnest(range(1, len(w) - 11)) u(i)),
        f AS (SELECT g, min(doc_id) AS first FROM v GROUP BY g),
        gone AS (SELECT DISTINCT doc_id, i + j AS i FROM v JOIN f USING (g), unnest(range(0, 13)) u(j) WHERE first < doc_id),
        kept AS (SELECT o.doc_id, string_agg(o.x, ' ' ORDER BY o.i) AS t, count(*) AS n
                 FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w) o ANTI JOIN gone g ON o.doc_id = g.doc_id AND o.i = g.i GROUP BY o.doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)""",
}
