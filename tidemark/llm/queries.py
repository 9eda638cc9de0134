"""The registered queries op1 to op13: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, chat, jaccard, langid, linededup, merkle, packing, repair, sentencepiece_bpe, simhash, topk, toxicity, warc
from tidemark.llm.common import cut, held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, score_col="score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    encoded = sentencepiece_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    done = sentencepiece_bpe.decode(encoded, path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.remove_repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "removed_lines")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    found = langid.identify(docs.select("doc_id", "text"), model, score_col="score")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = ann.nearest(rows, rows.where("vec_id % 100 = 0"), k=10)
    return found.withColumnRenamed("id", "vec_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    return chat.read_back(chat.format_conversations(rows.unionByName(more)))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("embedding").isNotNull() & finite).select("vec_id", topk.scaled("embedding").alias("vector"))
    found = topk.top_k(rows, rows.where("vec_id % 20 = 0"), k=20)
    return found.withColumnRenamed("id", "vec_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html")
    found = warc.read_archives(warc.archive(pages))
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return found.select(
        page("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: The letters that op11's tampering changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    found = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], presented={"text": tampered})
    return merkle.verified(found).drop("source")


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_sets(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = cut(repair.repair(repair.damaged(table(spark, sf_dir, "conversations"))))
    return repair.digests(repaired).withColumnRenamed("conv", "conv_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_sentencepiece, op3_line_dedup, op4_language_id, op5_simhash, op6_ann, op7_chat, op8_top_k, op9_warc, op10_packing, op11_merkle, op12_jaccard, op13_repair)}


#: Texts are compared by code points in both engines.
ORACLE_SQL = {
    "op8_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), g AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS holder FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
        FROM g""",
}


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text of ASCII characters as an expression of DuckDB, bit by bit."""
    bit = "lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    octets = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda r, x: list_reduce(CAST(range(8) AS BIGINT[]), {bit}, xor(r, x)), CAST(4294967295 AS BIGINT)), 4294967295)"


def merkle_sql() -> str:
    """op11 in SQL: trees of at most 16 ** 9 leaves a source, and of at most 16 ** 5 sources."""

    def tree(name: str, depth: int) -> str:
        """CTEs of the levels over {name}0 (g, i, n, h), their runs of children, and the roots."""
        out = []
        for k in range(depth):
            out.append(f"{name}_runs{k} AS (SELECT g, i // 16 AS p, max(n) AS n, list(h ORDER BY i) AS run FROM {name}{k} WHERE n > 1 GROUP BY g, p)")
            out.append(f"{name}{k + 1} AS (SELECT g, p AS i, (n + 15) // 16 AS n, sha256(list_aggregate(run, 'string_agg', '')) AS h FROM {name}_runs{k})")
        out.append(f"{name}_roots AS ({' UNION ALL '.join(f'SELECT g, h FROM {name}{k} WHERE n = 1' for k in range(depth + 1))})")
        return ", ".join(out)

    def climb(into: str, start: str, name: str, depth: int) -> str:
        """CTEs that take rows (id, g, i, n, h: hash so far, proof) up a tree; {into} has what they are at its top."""
        out = [f"{into}0 AS ({start})"]
        for k in range(depth):
            at = "CAST(c.i % 16 AS BIGINT)"
            before, after = (f"coalesce(list_aggregate({x}, 'string_agg', ''), '')" for x in (f"r.run[1:{at}]", f"r.run[{at} + 2:]"))
            up = f"SELECT c.id, c.g, c.i // 16 AS i, (c.n + 15) // 16 AS n, sha256({before} || c.h || {after}) AS h, c.proof || {before} || {after} AS proof FROM {into}{k} c JOIN {name}_runs{k} r ON c.g = r.g AND c.i // 16 = r.p WHERE c.n > 1"
            out.append(f"{into}{k + 1} AS ({up} UNION ALL SELECT * FROM {into}{k} WHERE n = 1)")
        return ", ".join(out)

    fields = lambda text: " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "source", "lang", "n_chars", text))
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"""
        WITH d AS (SELECT *, {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 AS tampered FROM documents),
        leaves AS (
            SELECT doc_id AS id, coalesce('=' || source, '') AS g, sha256({fields("text")}) AS h,
                CASE WHEN tampered THEN sha256({fields(lowered)}) ELSE sha256({fields("text")}) END AS shown FROM d
        ),
        s0 AS (SELECT id, g, row_number() OVER (PARTITION BY g ORDER BY id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, h, shown FROM leaves),
        {tree("s", 9)},
        u0 AS (SELECT '' AS g, g AS source, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM s_roots),
        {tree("u", 5)},
        {climb("a", "SELECT id, g, i, n, shown AS h, '' AS proof FROM s0", "s", 9)},
        {climb("b", "SELECT a9.id, '' AS g, u0.i, u0.n, a9.h, a9.proof FROM a9 JOIN u0 ON a9.g = u0.source", "u", 5)}
        SELECT s0.id AS doc_id, s0.h AS leaf, s_roots.h AS subroot, u_roots.h AS root, sha256(b5.proof) AS proof_sha256, b5.h AS folded_root, b5.h = u_roots.h AS verified
        FROM s0 JOIN s_roots ON s0.g = s_roots.g JOIN b5 ON s0.id = b5.id, u_roots"""


def repair_sql() -> str:
    """op13 in SQL: the best way to each state of the grammar, row by row (s: nothing yet, y: after system, u and a: after those)."""
    crc = crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")
    add = lambda way, cost, edit: f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'x': {way}.x || '{edit}'}} END"
    best = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda z: z IS NOT NULL))"
    when = lambda where, way: f"CASE WHEN {where} THEN {way} END"
    to_user = best("u", add("s", 5, "I"), add("y", 5, "I"), add("a", 5, "I"))
    to_assistant = best("a", add("cu", 5, "I"))
    return rf"""
        WITH RECURSIVE raw AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS how FROM conversations
        ), after AS (
            SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
                CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM raw, unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(k)
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM after
        ), judged AS (
            SELECT *, left(role, 1) AS letter, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
                CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' END AS fault
            FROM placed
        ), kinds AS (
            SELECT conv_id, pos, letter, coalesce(fault IN ('blank', 'duplicate'), false) AS must_go, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM judged
        ), ids AS (SELECT DISTINCT conv_id FROM conversations),
        way AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS pos, {{'c': CAST(0 AS BIGINT), 'x': ''}} AS s, CAST(NULL AS STRUCT(c BIGINT, x VARCHAR)) AS y,
                CAST(NULL AS STRUCT(c BIGINT, x VARCHAR)) AS u, CAST(NULL AS STRUCT(c BIGINT, x VARCHAR)) AS a FROM ids
            UNION ALL
            SELECT conv_id, pos, {add("s", 2, "D")},
                {best(add("y", 2, "D"), when("not must_go AND letter = 's'", add("s", "more", "K")))},
                {best(add("cu", 2, "D"), when("not must_go AND letter = 'u'", add("free", "more", "K")), when("not must_go", add("free", "1 + more", "R")))},
                {best(add("ca", 2, "D"), when("not must_go AND letter = 'a'", add("cu", "more", "K")), when("not must_go", add("cu", "1 + more", "R")))}
            FROM (SELECT *, {best("s", "y", "ca")} AS free FROM (SELECT *, {to_assistant} AS ca FROM (
                SELECT w.conv_id, k.pos, s, y, u, a, letter, must_go, more, {to_user} AS cu
                FROM way w JOIN kinds k ON w.conv_id IS NOT DISTINCT FROM k.conv_id AND k.pos = w.pos + 1)))
        ), ends AS (
            SELECT conv_id, {best("s", "ca")} AS won FROM (SELECT *, {to_assistant} AS ca FROM (
                SELECT *, {to_user} AS cu FROM way QUALIFY pos = max(pos) OVER (PARTITION BY conv_id)))
        ), steps AS (
            SELECT conv_id, k, won.x[k] AS edit, len(replace(won.x[:k], 'I', '')) AS pos, len(replace(won.x[:k], 'D', '')) AS nth FROM ends, unnest(range(1, len(won.x) + 1)) AS steps(k)
        ), turns AS (
            SELECT s.*, j.role, CASE WHEN edit = 'I' THEN '' ELSE j.text END AS text,
                max(CASE WHEN nth = 1 AND edit = 'K' AND letter = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS skipped
            FROM steps s LEFT JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND s.pos = j.pos WHERE edit <> 'D'
        ), repaired AS (
            SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - skipped) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS whole FROM turns GROUP BY conv_id
        ), counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
        )
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            won.c AS cost, won.x AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM ends e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON e.conv_id IS NOT DISTINCT FROM r.conv_id"""


#: op12 in SQL: all pairs of different sets that share a shingle, then the smallest id reachable.
JACCARD_SQL = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
    ), s AS (
        SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
            ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END)) AS shingles FROM w
    ), classes AS (
        SELECT min(doc_id) AS node, shingles FROM s WHERE len(shingles) > 0 GROUP BY shingles
    ), entries AS (
        SELECT node, len(shingles) AS n, unnest(shingles) AS h FROM classes
    ), links AS (
        SELECT x.node AS a, y.node AS b FROM entries x JOIN entries y ON x.h = y.h AND x.node < y.node AND 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n
        GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
    ), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (
        SELECT node AS a, node AS root FROM classes
        UNION
        SELECT e.b, r.root FROM reach r JOIN both_ways e ON r.a = e.a
    ), least_root AS (SELECT a, min(root) AS root FROM reach GROUP BY a)
    SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(root, s.doc_id) AS component_id
    FROM s LEFT JOIN classes c ON s.shingles = c.shingles LEFT JOIN least_root ON c.node = a"""


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL | {"op12_jaccard": JACCARD_SQL, "op11_merkle": merkle_sql(), "op13_repair": repair_sql()}
