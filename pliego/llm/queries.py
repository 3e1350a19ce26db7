"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.llm import ann, bpe, codes, jaccard, langid, licenses, packing, runs, simhash, token_counts, topk, toxicity, warc
from pliego.llm.tables import fold, table, tokenizer_path


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows.where(F.col("vec_id") % 50 == 0), rows)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(fold("doc_id", 4) != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    joined = [F.array_join(c, " ").alias(c) for c in ("sentence_ids", "licenses", "mentioned", "unmatched")]
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), *joined)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(fold("doc_id", 5) != 0))
    found = toxicity.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.as_warc(warc.derive(warc.responses(table(spark, sf_dir, "pages"))))
    return records.select("*", F.octet_length("warc").cast("long").alias("record_bytes"), F.crc32("warc").alias("record_crc32")).drop("warc")


def op10_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows.where(F.col("vec_id") % 50 == 0), rows)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = codes.learn(rows)
    coded = codes.with_sum_by(codes.encode(rows, model), "label", "error", "label_error")
    sums = F.coalesce(*[F.when(F.col("length") == d, F.lit(model.sha256(d))) for d in model.books], F.lit(None).cast("string"))
    return coded.select("vec_id", codes.hexed("code").alias("code"), "error", "label_error", sums.alias("codebooks_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.planted(table(spark, sf_dir, "documents"))))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_exact_topk, op2_best_fit_packing, op3_token_counts, op4_byte_bpe, op5_simhash, op6_language_id, op7_license_scan, op8_toxicity, op9_warc_derivatives,
    op10_adaptive_ann, op11_vector_codes, op12_periodic_runs, op13_jaccard_join
)}


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _license_sql() -> str:
    text, of = _sql_text, licenses
    sub = lambda x, pattern, by: f"regexp_replace({x}, {text(pattern)}, {by}, 'g')"
    fits = lambda s, known: "CASE " + " ".join(f"WHEN regexp_full_match({s}, {text(p)}) THEN {text(n)}" for n, p in known) + " END"
    untagged = sub(sub("text", f"(?i){of.SPDX}", "chr(10) || chr(10)"), of.LINK, "'\\1'")
    plain = f"chr(10) || replace(replace({untagged}, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10)"
    plain = sub(sub(plain, of.LEAD, "chr(10)"), of.ITEM, "chr(10) || chr(10)")
    plain = f"replace(lower(translate({plain}, '|/~', '   ')), 'licence', 'license')"
    plain = sub(sub(sub(plain, r"[ \t]+", "' '"), r"\n\n+", "chr(10) || '|'"), of.STOP, "'~'")
    plain = sub(sub(f"replace({plain}, chr(10), '/')", r"[^a-z0-9.+|/~]+", "' '"), r" ?/[ /]*", "'/'")
    plain = sub(sub(f"'|' || {plain} || '|'", r"[ /]?~[ /~]*", "'~'"), r"[ /~]?\|[ /~|]*", "'|'")
    known = [(of.SAME.get(i, i), p) for i, p in of.KNOWN]
    inner = "x[2:length(x) - 1]"
    join = lambda x: f"coalesce(list_aggregate({x}, 'string_agg', ' '), '')"
    rules = "MAP {" + ", ".join(f"{text(s)}: {text(n)}" for s, n in of.BY_SEQUENCE.items()) + "}"
    cased = "MAP {" + ", ".join(f"{text(n.lower())}: {text(n)}" for n in of.NAMES) + "}"
    some = lambda x: f"list_filter({x}, lambda y: y IS NOT NULL)"
    denied = f"regexp_matches({sub(sub("' ' || m.said || ' '", '[|/~]+', "' '"), of.OTHERWISE, "' '")}, {text(of.DENIED)})"
    tail = f"' ' || regexp_replace(m.said, {text(of.FRONT)}, '') || ' '"
    named = some(f"list_transform(regexp_extract_all({tail}, {text(of.NAMED_BARE)}), lambda x: 'notice:' || {fits(inner, of.CALLED_BARE)})")
    bare = sub(sub("e", "[()]", "' '"), r"(?i)[ \t]+WITH[ \t]+[^ \t]+", "''")
    parts = f"flatten(list_transform(regexp_extract_all(text, {text(f'(?i){of.SPDX}')}, 1), lambda e: regexp_split_to_array({bare}, {text(r'(?i)[ \t]+(?:AND|OR)[ \t]+')})))"
    later = f"list_transform({parts}, lambda t: regexp_replace(trim(t), {text(r'\+$')}, '-or-later'))"
    return f"""
WITH hinted AS (SELECT doc_id, CASE WHEN {" OR ".join(f"contains(lower(text), {text(h)})" for h in of.HINTS)} THEN text END AS text FROM documents),
streams AS (SELECT doc_id, text, coalesce(replace(replace(replace({plain}, '|', '||'), '/', '//'), '~', '~~'), '') AS stream FROM hinted),
matched AS (SELECT doc_id, text, stream, list_transform(regexp_extract_all(stream, {text(of.ANY)}), lambda x: {{'said': {inner}, 'id': {fits(inner, known)}}}) AS matched FROM streams),
found AS (SELECT doc_id, flatten(list_transform(matched, lambda m: CASE WHEN m.id IS NOT NULL THEN [m.id] WHEN {denied} THEN [] ELSE {named} END)) AS ids,
  coalesce(list_transform({later}, lambda t: coalesce({cased}[lower(t)], t)), []) AS tags,
  {sub("stream", of.ANY, "'||'")} || coalesce(list_aggregate(list_transform(list_filter(matched, lambda m: m.id IS NULL AND {denied}), lambda m: '|' || m.said || '|'), 'string_agg', ''), '') AS rest FROM matched),
called AS (SELECT *, {some(f"list_transform(regexp_extract_all(rest, {text(of.NAMED)}), lambda x: {fits(inner, of.CALLED)})")} AS names, ';' || coalesce(list_aggregate(ids, 'string_agg', ';;'), '') || ';' AS in_row FROM found),
granted AS (SELECT *, list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(in_row, {text(of.RULE)}), lambda x: {rules}[x]), tags))) AS licenses FROM called)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, {join("ids")} AS sentence_ids, {join("licenses")} AS licenses,
  {join("list_sort(list_distinct(list_filter(names, lambda x: NOT list_contains(licenses, x))))")} AS mentioned,
  {join(f"list_filter(regexp_split_to_array({sub("in_row", of.RULE, text('|'))}, '[;|]+'), lambda x: x <> '')")} AS unmatched
FROM granted"""


def _top_k_sql() -> str:
    return """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def _codes_sql() -> str:
    def nearest(name: str, book: str) -> str:
        away = "list_inner_product(a.x, a.x) - 2 * list_inner_product(a.x, b.x) + list_inner_product(b.x, b.x)"
        return f"""{name} AS (SELECT a.vec_id, a.p, any_value(a.x) AS x, CAST(min(({away}) * 64 + b.e) AS BIGINT) AS key FROM parts a JOIN {book} b ON a.p = b.p GROUP BY a.vec_id, a.p)"""

    def moved(name: str, at: str, book: str) -> str:
        one = f"SELECT p, key % 64 AS e, i, floor(CAST(sum(CAST(x[i] AS BIGINT)) AS DOUBLE) / count(*)) AS x FROM {at}, range(1, len(x) + 1) r(i) GROUP BY ALL"
        return f"""{name} AS (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM {book} b LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS x FROM ({one}) GROUP BY p, e) n ON b.p = n.p AND b.e = n.e)"""

    return f"""
WITH ok AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM ok, range(16) r(p)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM ok ORDER BY vec_id LIMIT 64),
b0 AS (SELECT p, e, x FROM parts JOIN firsts USING (vec_id)),
{nearest("a1", "b0")}, {moved("b1", "a1", "b0")}, {nearest("a2", "b1")}, {moved("b2", "a2", "b1")}, {nearest("a3", "b2")},
coded AS (SELECT vec_id, string_agg(printf('%02x', key % 64), '' ORDER BY p) AS code, CAST(sum(key // 64) AS BIGINT) AS error FROM a3 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(x[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) FROM b2, range(1, len(x) + 1) r(i)) AS codebooks_sha256
FROM coded JOIN ok USING (vec_id)"""


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _runs_sql() -> str:
    shift = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    octets = "list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, o: list_reduce(list_prepend(xor(c, o), range(8)), lambda x, y: {shift})), 4294967295)"
    turned = "list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END])"
    return f"""
WITH given AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w, {crc} AS h FROM documents),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM given),
sized AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM placed),
turned AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE {turned} END AS w FROM sized),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM turned),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
found AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM found GROUP BY doc_id),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM found),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM given LEFT JOIN lines USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _jaccard_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(lower)} AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 3) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) AS g FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 185 * c >= 85 * (a.n + b.n)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u) LEFT JOIN sizes USING (doc_id)"""


ORACLE_SQL = {
    "op1_exact_topk": _top_k_sql(),
    "op7_license_scan": _license_sql(),
    "op11_vector_codes": _codes_sql(),
    "op12_periodic_runs": _runs_sql(),
    "op13_jaccard_join": _jaccard_sql(),
}
