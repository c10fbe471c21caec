"""The registered queries of this package: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridindex.llm import bpe, centroids, decontaminate, licenses, minhash, pii, quality, secret_scan, simhash, spelling, token_counts, token_files, toxicity
from gridindex.llm.ranges import scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op3_hyperminhash": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
 ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
 reach(doc_id, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT ways.y, reach.m FROM reach JOIN ways ON ways.x = reach.doc_id),
 c AS (SELECT doc_id, min(m) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
}


def _secret_oracle() -> str:
    """The rules, the two models and the scores of op8, as SQL."""
    quoted = {k: "'" + v.replace("'", "''") + "'" for k, v in (("0", secret_scan.ASSIGN), ("1", secret_scan.ACCESS), ("2", secret_scan.HEX), ("3", secret_scan.TOKEN))}
    found = " UNION ALL ".join(f"SELECT rid, {k} AS kind, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS gs, regexp_extract_all(t, {p}, {2 if k == '0' else 0}) AS vs FROM d" for k, p in quoted.items())
    a = secret_scan.ALPHABET
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), m AS ({found}),
 u AS (SELECT rid, kind, ms, gs, vs, unnest(generate_series(1, len(ms))) AS k FROM m WHERE len(ms) > 0),
 s AS (SELECT rid, kind, vs[k] AS v, (list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::BIGINT AS st, length(ms[k]) AS n FROM u),
 base AS (SELECT rid, kind, v, st, st + n AS en FROM s WHERE kind = 0 AND length(v) >= 6 OR kind = 1 AND length(v) >= 20 OR kind = 2),
 tok AS (SELECT row_number() OVER () AS cid, rid, v, st, st + n AS en FROM s WHERE kind = 3),
 cand AS (SELECT * FROM tok WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = tok.rid AND b.st < tok.en AND tok.st < b.en)),
 smp AS (SELECT true AS r, v FROM base UNION ALL SELECT false, v FROM cand),
 pr AS (SELECT r, unnest(list_transform(generate_series(1, length(v) - 1), lambda i: substring(v, i, 2))) AS p FROM smp),
 pc AS (SELECT p, count_if(r) AS r, count_if(NOT r) AS o FROM pr WHERE regexp_full_match(p, '[A-Za-z0-9+/_.=-][A-Za-z0-9+/_.=-]') GROUP BY p),
 f AS (SELECT left(p, 1) AS a, sum(r) AS r, sum(o) AS o FROM pc GROUP BY 1),
 llr AS (SELECT p, ln(((pc.r + 1) / (f.r + {a})) / ((pc.o + 1) / (f.o + {a}))) AS x FROM pc JOIN f ON a = left(p, 1) UNION ALL SELECT a, ln((o + {a}) / (r + {a})) FROM f),
 cp AS (SELECT cid, length(v) - 1 AS n, unnest(list_transform(generate_series(1, length(v) - 1), lambda i: substring(v, i, 2))) AS p FROM cand),
 sc AS (SELECT cid FROM cp LEFT JOIN llr two ON two.p = cp.p LEFT JOIN llr one ON one.p = left(cp.p, 1) GROUP BY cid, n HAVING sum(coalesce(two.x, one.x, 0)) > greatest({secret_scan.THRESHOLD} * n, {secret_scan.EVIDENCE})),
 sp AS (SELECT rid, kind, st, en FROM base UNION ALL SELECT rid, 3, st, en FROM cand JOIN sc USING (cid)),
 w AS (SELECT rid, kind, st, en, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || st || ':' || en AS x FROM sp),
 g AS (SELECT rid, count_if(kind = 0) AS a, count_if(kind = 1) AS b, count_if(kind = 2) AS c, count_if(kind = 3) AS e, string_agg(x, ',' ORDER BY st, kind, en) FILTER (kind < 3) AS bs, string_agg(x, ',' ORDER BY st, kind, en) AS al FROM w GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(al, '') AS spans, coalesce(e, 0) AS n_random FROM d LEFT JOIN g USING (rid)"""


ORACLES["op8_secret_markov"] = _secret_oracle()


def _cluster_oracle(k: int = centroids.K, rounds: int = centroids.ROUNDS, dim: int = centroids.DIM) -> str:
    """op11's rounds, one after another, by distances to all centroids."""
    digest = f"sha256('{centroids.SEED}:' || vec_id)"
    square = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim} AND len(embedding) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {digest}) - 1 AS c, v FROM k ORDER BY {digest} LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, min({square}::HUGEINT * {k} + c.c) AS x FROM k CROSS JOIN c{i} c GROUP BY r)")
        if i < rounds:
            mean = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"
            parts.append(f"m{i} AS (SELECT c, list(x ORDER BY p) AS v FROM (SELECT c, p, {mean} AS x FROM (SELECT a.x % {k} AS c, unnest(range({dim})) AS p, unnest(k.v) AS x FROM a{i} a JOIN k USING (r)) GROUP BY c, p) GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (c))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, (x % {k})::INTEGER AS cluster, (x // {k})::BIGINT AS distance, (sum(x // {k}) OVER (PARTITION BY x % {k}))::BIGINT AS cluster_inertia, (sum(x // {k}) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
 FROM a{rounds} JOIN k USING (r) JOIN c{rounds} c ON c.c = x % {k}"""


ORACLES["op11_equal_average"] = _cluster_oracle()
ORACLES["op12_spelling_automata"] = rf"""WITH RECURSIVE byte AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
 d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
 r AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM d) WHERE length(w) >= {spelling.MIN_LENGTH} GROUP BY 1, 2),
 x AS (SELECT w, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM r),
 h AS (SELECT w, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || substring(x, i, 2))::BIGINT)), lambda a, b: xor(a // 256, byte.t[xor(a, b) % 256 + 1]))) AS h FROM x, byte),
 s AS (SELECT CASE WHEN h % {spelling.MODULUS} = 0 THEN left(w, (h % length(w))::BIGINT) || substring(w, (h % length(w))::BIGINT + 2) ELSE w END AS w, c FROM h),
 v AS MATERIALIZED (SELECT w, sum(c)::BIGINT AS n FROM s WHERE length(w) >= {spelling.MIN_LENGTH} GROUP BY w HAVING sum(c) >= {spelling.MIN_COUNT}),
 g AS MATERIALIZED (SELECT w, i, left(w, i - 1) || substring(w, i + 1) AS x FROM (SELECT w, unnest(generate_series(1, length(w))) AS i FROM v)),
 e AS MATERIALIZED (SELECT g.w AS a, v.w AS b FROM g JOIN v ON v.w = g.x UNION SELECT v.w, g.w FROM g JOIN v ON v.w = g.x UNION SELECT p.w, q.w FROM g p JOIN g q ON p.x = q.x AND p.i = q.i AND p.w <> q.w),
 f AS (SELECT a AS w, count(*) AS n_near, arg_min(b, (-v.n, b)) AS o, max(v.n) AS m FROM e JOIN v ON v.w = b GROUP BY a),
 l AS MATERIALIZED (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling.RATIO} * n THEN o END AS form, CASE WHEN m >= {spelling.RATIO} * n THEN m END AS form_n FROM v LEFT JOIN f USING (w)),
 way(w, here, steps) AS (SELECT w, w, 0 FROM l UNION ALL SELECT way.w, l.form, steps + 1 FROM way JOIN l ON l.w = way.here WHERE l.form IS NOT NULL),
 ends AS (SELECT w, arg_max(here, steps) AS root FROM way GROUP BY w)
SELECT w AS word, form, root, n, n_near, form_n FROM l JOIN ends USING (w)"""


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in the documents, and where."""
    return decontaminate.contaminated(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the token automaton."""
    return bpe.encode_documents(spark, _table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return minhash.near_duplicates(spark, _table(spark, sf_dir, "documents"), size=4)


def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to block files and read back."""
    path = scratch(spark, "token_files")
    token_files.write(spark, _table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"))
    return token_files.read(spark, path, "ids_crc32 long", token_files.crc32)


def op5_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.scan(_table(spark, sf_dir, "documents"))


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return quality.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and template spans in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by rules and by models trained on all of them."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op9_simhash_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return simhash.edited(spark, _table(spark, sf_dir, "documents"))


def simhash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and how many other documents' are within three bits, by permuted block tables."""
    prints = simhash.fingerprint(_table(spark, sf_dir, "documents")).withColumn("bits", F.conv("fingerprint", 16, -10).cast("long"))
    return prints.join(simhash.near_counts(spark, prints), "bits", "left").select("doc_id", "fingerprint", "n_near")


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity grade of every document."""
    return toxicity.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_equal_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector, by whole numbers."""
    return centroids.cluster(spark, _table(spark, sf_dir, "embeddings"))


def op12_spelling_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual form of every word of the documents, and how many words are near it."""
    return spelling.variants(spark, _table(spark, sf_dir, "documents"))


def op13_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, from counts of its pre-tokens."""
    return token_counts.count_tokens(spark, _table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_latent_leaks": op1_latent_leaks,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_hyperminhash": op3_hyperminhash,
    "op4_token_blocks": op4_token_blocks,
    "op5_pii_anchors": op5_pii_anchors,
    "op6_cotraining": op6_cotraining,
    "op7_license_automaton": op7_license_automaton,
    "op8_secret_markov": op8_secret_markov,
    "op9_simhash_edits": op9_simhash_edits,
    "op10_ordinal_toxicity": op10_ordinal_toxicity,
    "op11_equal_average": op11_equal_average,
    "op12_spelling_automata": op12_spelling_automata,
    "op13_pretoken_counts": op13_pretoken_counts,
    "simhash_neighbours": simhash_neighbours,
}
