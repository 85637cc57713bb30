"""Registered queries of the operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import chat, exact_dedup, html_content, line_frequency, mixing, ngram_join, pii, simhash, spelling, substring_dedup, tier_packing, token_packing, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in rows of 2048 ids."""
    return token_packing.pack_matrix(table(spark, sf_dir, "documents"), vocabulary(), end_id=49407)


@query
def op2_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_content.extract_main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judge(table(spark, sf_dir, "documents")).drop("key", "removed_lines")


ORACLES["op3_line_frequency"] = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), worded AS (
    SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words FROM docs
), windows AS (
    SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
    FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM worded WHERE len(words) > 2)
), repeated AS (
    SELECT k, count(DISTINCT i + j) AS n FROM (SELECT k, i, count(*) OVER (PARTITION BY k, w) AS c FROM windows), range(3) r(j)
    WHERE c > 1 GROUP BY k
), lines AS (
    SELECT k, host, text, line, len(regexp_extract_all(line, '[^ 	-
]+')) AS n
    FROM (SELECT k, host, text, unnest(string_split(text, chr(10))) AS line FROM docs)
), doubled AS (
    SELECT k, (count(*) - count(DISTINCT line))::BIGINT AS n FROM lines WHERE n > 0 GROUP BY k
), normal AS (
    SELECT k, host, text, n,
           regexp_replace(lower(trim(regexp_replace(line, '[ 	-
]+', ' ', 'g'))), '[0-9]+', '0', 'g') AS line
    FROM lines WHERE n > 0
), frequent AS (
    SELECT host, line FROM normal GROUP BY host, line HAVING count(DISTINCT text) > {line_frequency.MOST_DOCUMENTS}
), removed AS (
    SELECT k, sum(n) AS n FROM normal JOIN frequent USING (host, line) GROUP BY k
), measured AS (
    SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[ 	-
]', '', 'g')) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines,
           coalesce(r.n, 0) AS n_repeat_words, coalesce(x.n, 0)::BIGINT AS n_removed
    FROM worded LEFT JOIN doubled d USING (k) LEFT JOIN repeated r USING (k) LEFT JOIN removed x USING (k)
)
SELECT *, n_words < {line_frequency.LEAST_WORDS} OR 100 * n_repeat_words > {line_frequency.MOST_REPEATED_PERCENT} * n_words AS base_failed,
       NOT (n_words < {line_frequency.LEAST_WORDS} OR 100 * n_repeat_words > {line_frequency.MOST_REPEATED_PERCENT} * n_words
            OR n_words - n_removed < {line_frequency.LEAST_LEFT} * n_words) AS kept
FROM measured
"""


@query
def op4_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 512 to 4096 ids."""
    return tier_packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


@query
def op5_perfect_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, read as two deliveries: those with even ids came first and are the history."""
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"), F.col("doc_id") % 2 == 0)


ORACLES["op5_perfect_hash"] = r"""
WITH digested AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM digested WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
"""


@query
def op6_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op6_suffix_automata"] = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) > 19)
), repeats AS (
    SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
), covered AS (
    SELECT DISTINCT doc_id, i + j AS i FROM repeats, range(20) t(j)
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
    FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs) ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the posteriors, rates and copies of a mix of 94 % good, 5 % poor and 1 % toxic tokens."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "n_tokens", *[F.round(d, 6).alias(f"p_{d}") for d in mixing.DOMAINS], F.round("rate", 6).alias("rate"), "copies")


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[count(kind) for kind in pii.BASE], F.sha2(span_list(base), 256).alias("base_sha256"),
                        span_list(F.col("spans")).alias("spans"))


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are made of control strings, read back from their marked-up form."""
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    out = chat.format_conversations(rows).withColumn("turns", chat.read_back(F.col("formatted")))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op10_chat_format"] = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
    SELECT *, coalesce(role = lag(role) OVER w, false) AS joins,
           regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|NEXT\])', '\1\2\\\3', 'g') AS safe
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(safe) + CASE WHEN joins THEN length('[NEXT]') ELSE length('<s>[INST]' || role || '[/INST]' || '</s>') END)::BIGINT
           AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query
def op11_anchor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def _codes_sql(rounds: int = vector_codes.ROUNDS, width: int = 8) -> str:
    """Assignments and codebooks of all rounds, one after the other, for parts of eight components."""
    away = " + ".join(f"(a.v[{i}] - c.v[{i}]) * (a.v[{i}] - c.v[{i}])" for i in range(1, width + 1))
    floor = ", ".join(f"(sum(a.v[{i}])::BIGINT - ((sum(a.v[{i}])::BIGINT % count(*)) + count(*)) % count(*)) // count(*)" for i in range(1, width + 1))
    steps = ""
    for r in range(rounds + 1):
        steps += f"""
), near{r} AS MATERIALIZED (
    SELECT a.k, a.p, min({{'d': {away}, 'e': c.e}}) AS best FROM parts a JOIN book{r} c USING (p) GROUP BY a.k, a.p"""
        if r < rounds:
            steps += f"""
), book{r + 1} AS MATERIALIZED (
    SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM book{r} c LEFT JOIN (
        SELECT p, n.best.e AS e, [{floor}] AS v FROM parts a JOIN near{r} n USING (k, p) GROUP BY p, n.best.e) m USING (p, e)"""
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT k, p, v[{width} * p + 1:{width} * p + {width}] AS v FROM kept, range({vector_codes.PARTS}) t(p)
), book0 AS (
    SELECT p, k - 1 AS e, v FROM parts WHERE k <= {vector_codes.ENTRIES}{steps}
), coded AS (
    SELECT k, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY k
), digest AS (
    SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (k), digest
"""


ORACLES["op11_anchor_codes"] = _codes_sql()


@query
def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


ORACLES["op12_ngram_join"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS k, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT k, md5_number(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) > 4)
    UNION ALL SELECT k, md5_number(array_to_string(w, ' ') || chr(10)) FROM docs WHERE len(w) BETWEEN 1 AND 4
), sizes AS (
    SELECT k, count(*) AS n FROM shingles GROUP BY k
), shared AS (
    SELECT a.k AS u, b.k AS v, count(*) AS n FROM shingles a JOIN shingles b USING (s) GROUP BY u, v
), links AS (
    SELECT u, v FROM shared JOIN sizes a ON a.k = u JOIN sizes b ON b.k = v WHERE 100 * shared.n >= 80 * (a.n + b.n - shared.n)
), reach AS (
    WITH RECURSIVE r AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM r JOIN links l ON r.v = l.u) SELECT * FROM r
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(min(o.doc_id), d.doc_id), d.doc_id) AS component_id
FROM docs d LEFT JOIN sizes USING (k) LEFT JOIN reach ON u = d.k LEFT JOIN docs o ON o.k = v
GROUP BY d.k, d.doc_id, n
"""


@query
def op13_spelling_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


ORACLES["op13_spelling_trees"] = r"""
WITH table_of AS (
    SELECT list(list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
    FROM (SELECT unnest(range(256)) AS i)
), runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
    WHERE length(run) > 6 GROUP BY doc_id, run
), coded AS (
    SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs
), hashed AS (
    SELECT run, n, xor(list_reduce(range(len(x) // 2), lambda c, j: xor(c >> 8, t[1 + (xor(c, ('0x' || x[2 * j + 1:2 * j + 2])::BIGINT) & 255)]),
                                   4294967295), 4294967295) AS h
    FROM coded, table_of
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
    WHERE length(word) > 6 GROUP BY word HAVING sum(n) > 1
), less AS (
    SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.rest, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, (list({'o': other, 'n': n} ORDER BY n DESC, encode(other)))[1] AS b FROM near GROUP BY word
), formed AS (
    SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * w.n THEN b.o END AS form, CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n
    FROM words w LEFT JOIN best USING (word)
), follow AS (
    WITH RECURSIVE f AS (
        SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT f.word, f.next, g.form FROM f JOIN formed g ON g.word = f.next)
    SELECT word, root FROM f WHERE next IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN follow USING (word)
"""
