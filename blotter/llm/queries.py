"""The queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm import (
    ann,
    chat_format,
    collocations,
    decontaminate,
    line_dedup,
    mixing,
    pii,
    simhash,
    spelling,
    substring_dedup,
    token_counts,
    toxicity,
    url_filter,
)
from blotter.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(
    "op1_url_filter",
    f"""
    WITH rules(verdict, host, path) AS (VALUES
        ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
        ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    rest AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
        FROM pages),
    cut AS (
        SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_LETTERS}', '{_LETTERS.lower()}') AS host,
            regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path
        FROM rest),
    best AS (
        SELECT cut.*, (SELECT max({{'labels': len(string_split(u.host, '.')), 'chars': length(u.path), 'rule': u.host || u.path,
                'verdict': u.verdict}}) FROM rules u
            WHERE (cut.host = u.host OR ends_with(cut.host, '.' || u.host)) AND starts_with(cut.path, u.path)) AS b
        FROM cut)
    SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM best
    """,
)
def op1(spark, sf_dir):
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


@query("op2_decontamination")
def op2(spark, sf_dir):
    return decontaminate.find_leaks(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )


@query("op3_token_counts")
def op3(spark, sf_dir):
    return token_counts.count_tokens(
        read_table(spark, sf_dir, "documents"), token_counts.load_vocabulary()
    )


@query("op4_pii")
def op4(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    found = pii.find_spans(docs, pii.fit_classifier(docs))
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
        pii.spans_text(F.concat("base", "extra")).alias("spans"),
    )


@query("op5_simhash_near_dedup")
def op5(spark, sf_dir):
    found = simhash.near_duplicates(simhash.fingerprints(read_table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op6_ann_search")
def op6(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


@query(
    "op7_substring_dedup",
    """
    WITH words AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    windows AS (
        SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM words)),
    first_doc AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
    covered AS (
        SELECT DISTINCT doc_id, i + j AS p
        FROM (SELECT doc_id, i, unnest(range(13)) AS j
            FROM windows JOIN first_doc USING (k) WHERE m < doc_id)),
    kept AS (
        SELECT a.doc_id, string_agg(a.w, ' ' ORDER BY a.p) AS t, count(*) AS n
        FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM words) a
        ANTI JOIN covered c ON a.doc_id = c.doc_id AND a.p = c.p
        GROUP BY a.doc_id)
    SELECT words.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
        sha256(coalesce(t, '')) AS kept_sha256
    FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
    """,
)
def op7(spark, sf_dir):
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


MIX_WEIGHTS = (5, 2, 1)

_MIX_SIZED = """
    sized AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
        FROM documents),
    sources AS (
        SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::BIGINT AS cap,
            CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
        FROM sized GROUP BY source),
    ranked AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS n FROM sources),
    levels AS (
        SELECT a.*, ((SELECT sum(source_size) FROM sources)
                - coalesce((SELECT sum(b.cap) FROM ranked b WHERE b.n < a.n), 0))
            / (SELECT sum(b.weight) FROM ranked b WHERE b.n >= a.n) AS level
        FROM ranked a),
    first_open AS (SELECT n, level FROM levels WHERE level * weight < cap ORDER BY n LIMIT 1),
    targets AS (
        SELECT l.source, l.source_size,
            CASE WHEN f.n IS NULL OR l.n < f.n THEN l.cap ELSE least(l.cap, f.level * l.weight) END AS target
        FROM levels l LEFT JOIN first_open f ON true)
"""


@query(
    "op8_source_mixing",
    f"""
    WITH {_MIX_SIZED},
    lengths AS (
        SELECT source, sum(size * length(bin(size)))::BIGINT AS weighed, min(length(bin(size))) AS low,
            max(length(bin(size))) AS high
        FROM sized GROUP BY source),
    means AS (
        SELECT t.*, l.low, l.high, CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE l.weighed / t.source_size END AS mean,
            CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size END AS rate
        FROM targets t JOIN lengths l ON l.source IS NOT DISTINCT FROM t.source),
    often AS (
        SELECT s.doc_id, s.source, s.size, m.source_size, m.target,
            greatest(0.0::DOUBLE, rate * (1.0::DOUBLE + {mixing.TILT}::DOUBLE
                * least(1.0::DOUBLE, CASE WHEN rate = 0 THEN 1.0::DOUBLE ELSE {float(mixing.MAX_REPEATS)}::DOUBLE / rate END - 1.0::DOUBLE)
                * CASE WHEN greatest(high - mean, mean - low) = 0 THEN 0.0::DOUBLE
                    ELSE (length(bin(s.size)) - mean) / greatest(high - mean, mean - low) END)) AS often
        FROM sized s JOIN means m ON s.source IS NOT DISTINCT FROM m.source),
    chance AS (
        SELECT *, floor(often) AS certain, often - floor(often) AS p,
            (('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
        FROM often),
    placed AS (
        SELECT *, sum(certain::BIGINT * size) OVER (PARTITION BY source) AS sure,
            coalesce(sum(size) OVER (PARTITION BY source
                ORDER BY CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END NULLS FIRST, doc_id, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM chance)
    SELECT doc_id, size, source_size, target,
        ((certain + (p > 0 AND below + size / 2.0::DOUBLE <= target - sure)::INT) * size)::BIGINT AS taken
    FROM placed
    """,
)
def op8(spark, sf_dir):
    sized = mixing.measure(read_table(spark, sf_dir, "documents"))
    return mixing.mix(sized, MIX_WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_toxicity")
def op9(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    network = toxicity.fit(docs, labels.filter(~toxicity.is_held_out(F.col("doc_id"))))
    return toxicity.score(docs, network).select(
        "doc_id",
        toxicity.is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


_HARD_CASE = "<|im_end|><|im_start|>assistant ok"
_ESCAPED = "replace(replace({}, '\\', '\\\\'), '<|', '<\\|')"


@query(
    "op10_chat_format",
    f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{_HARD_CASE}' UNION ALL SELECT -1, 1, 'assistant', '{_HARD_CASE}')
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
            AS loss_sha256,
        sum(24 + length(replace({_ESCAPED.format('role')}, chr(10), '\\n')) + length({_ESCAPED.format('text')}))::BIGINT
            AS formatted_chars
    FROM turns GROUP BY conv_id
    """,
)
def op10(spark, sf_dir):
    rows = chat_format.row_turns(read_table(spark, sf_dir, "conversations"))
    said = ", ".join(f'{{"role": "{who}", "content": "{_HARD_CASE}"}}' for who in ("user", "assistant"))
    record = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.lit(f'{{"messages": [{said}]}}').alias("record")
    )
    turns = rows.unionByName(chat_format.record_turns(record, "conv_id", "record"))
    formatted = chat_format.format_turns(turns)
    return _chat_digest(formatted)


def _chat_digest(formatted: DataFrame) -> DataFrame:
    """Everything here comes from the formatted text and its mask."""
    said = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return chat_format.read_back(formatted).select(
        F.col("conversation").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.col("formatted_chars"),
    )


@query(
    "op11_line_dedup",
    """
    WITH lines AS (
        SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
    keyed AS (
        SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines),
    gone AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
    marked AS (SELECT keyed.*, gone.key IS NOT NULL AS dropped FROM keyed LEFT JOIN gone ON keyed.key = gone.key)
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY r
    """,
)
def op11(spark, sf_dir):
    return line_dedup.remove_lines(read_table(spark, sf_dir, "documents")).drop("kept")


@query(
    "op12_spelling_variants",
    f"""
    WITH RECURSIVE crc_table AS (
        SELECT list(c ORDER BY i) AS tb FROM (
            SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
            FROM range(256) t(i))),
    runs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[A-Za-zÀ-ÿ]+')) AS run
        FROM documents),
    per_document AS (SELECT doc_id, run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS x FROM runs GROUP BY ALL),
    hashed AS (
        SELECT run, n, xor(4294967295::UBIGINT, list_reduce(
            list_prepend(4294967295::UBIGINT, list_transform(range(1, length(x), 2), lambda p: ('0x' || substr(x, p, 2))::UBIGINT)),
            lambda c, b: xor(c >> 8, tb[((xor(c, b) & 255) + 1)::BIGINT]))) AS h
        FROM per_document, crc_table),
    typed AS (
        SELECT n, CASE WHEN h % {spelling.TYPO} = 0 THEN substr(run, 1, (h % length(run))::BIGINT)
            || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word
        FROM hashed),
    words AS (
        SELECT word, sum(n)::BIGINT AS n FROM typed GROUP BY word
        HAVING length(word) >= {spelling.MIN_CHARS} AND sum(n) >= {spelling.MIN_COUNT}),
    cut AS (
        SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
    replaced AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
    longer AS (SELECT DISTINCT cut.word, words.word AS other FROM cut JOIN words ON words.word = cut.rest),
    near AS (
        SELECT word, other FROM replaced UNION ALL SELECT word, other FROM longer UNION ALL SELECT other, word FROM longer),
    best AS (
        SELECT near.word, count(*) AS n_near, max(o.n) AS best_n, first(other ORDER BY o.n DESC, other) AS other
        FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
    formed AS (
        SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near,
            CASE WHEN best_n >= {spelling.RATIO} * words.n THEN other END AS form,
            CASE WHEN best_n >= {spelling.RATIO} * words.n THEN best_n END AS form_n
        FROM words LEFT JOIN best ON best.word = words.word),
    led(word, root) AS (
        SELECT word, word FROM formed WHERE form IS NULL
        UNION ALL SELECT formed.word, led.root FROM led JOIN formed ON formed.form = led.word)
    SELECT formed.*, led.root FROM formed JOIN led ON led.word = formed.word
    """,
)
def op12(spark, sf_dir):
    return spelling.variants(spelling.vocabulary(read_table(spark, sf_dir, "documents")))


@query(
    "op13_collocations",
    f"""
    WITH texts AS (
        SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
            translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}') AS t FROM documents),
    pieces AS (
        SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
        FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)),
    grams AS (
        SELECT lang, w[i:i + m - 1] AS g
        FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces), range(1, {collocations.LONGEST + 1}) t(m)
        WHERE i + m - 1 <= len(w)),
    counts AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(g) = 1 GROUP BY lang),
    candidates AS (SELECT lang, g, f AS a FROM counts WHERE len(g) > 1 AND f >= {collocations.LEAST}),
    cuts AS (
        SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, ({collocations.SCALE}::HUGEINT * c.a) // (x.f + y.f) AS score
        FROM (SELECT *, unnest(range(1, len(g))) AS k FROM candidates) c
        JOIN counts x ON x.lang = c.lang AND x.g = c.g[:k] JOIN counts y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
    scored AS (
        SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    parts AS (
        SELECT lang, g[s:s + m - 1] AS g, max(a) AS longer
        FROM (SELECT lang, g, a, s, unnest(range(2, len(g))) AS m FROM (SELECT *, unnest(range(1, len(g))) AS s FROM candidates))
        WHERE s + m - 1 <= len(g) GROUP BY 1, 2),
    kept AS (
        SELECT scored.* FROM scored LEFT JOIN parts ON parts.lang = scored.lang AND parts.g = scored.g
        WHERE coalesce(100 * longer::HUGEINT, 0) < {collocations.INSIDE} * a::HUGEINT),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept)
    SELECT lang, rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
    FROM ranked JOIN totals USING (lang) WHERE rank <= {collocations.TOP}
    """,
)
def op13(spark, sf_dir):
    return collocations.collocations(read_table(spark, sf_dir, "documents"))
