"""DuckDB SQL that gives the same results as the registered queries, on the same tables."""

from __future__ import annotations

from inkstone.functions.text import SPACE, TOKEN, WORD, WORD2
from inkstone.operators.leakage import FOLDS, STOP_WORDS
from inkstone.queries import CHUNK, FEWEST_CHUNKS, FOLD_CHUNK, PERMUTATIONS, SAMPLE, WORDS


def _norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'), ' ')"


def _key(x: str) -> str:
    return f"nullif(lower({_norm(x)}), '')"


def _pieces(x: str) -> str:
    return f"list_filter(string_split({_norm(x)}, ' '), lambda w: w <> '')"


def _words(x: str, pattern: str = WORD) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{pattern}')"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{TOKEN}')"


def _estimate(n: str) -> str:
    return f"CAST(round_even(({n}) * 1.33, 0) AS BIGINT)"


def _articles(name: str, table: str, where: str) -> str:
    extra = "nullif(lower(trim(topic, ' ')), '') AS topic, nullif(lower(trim(lang, ' ')), '') AS lang" if table == "essays" else "CAST(NULL AS VARCHAR) AS topic, CAST(NULL AS VARCHAR) AS lang"
    return f"""{name} AS (
  SELECT article_id, author, text, config, split, topic, lang
  FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY author, text, coalesce(config, ''), coalesce(split, ''), coalesce(topic, ''), coalesce(lang, '')) AS nth FROM (SELECT article_id, {_key('author')} AS author, trim(text, ' ') AS text, trim(config, ' ') AS config, lower(trim(split, ' ')) AS split, {extra} FROM {table})
  WHERE article_id IS NOT NULL AND author IS NOT NULL AND {_norm('text')} <> '' AND config {where}) WHERE nth = 1)"""


ESSAYS = _articles("articles", "essays", "= 'cross_topic_1'")
REFERENCE = _articles("reference", "reference_corpus", "IN ('cross_genre_2', 'cross_genre_3', 'cross_genre_4')")
BOTH = f"{ESSAYS}, {REFERENCE}, both_slices AS (SELECT * FROM articles UNION ALL SELECT * FROM reference)"


def _chunks(size: int, source: str = "articles", name: str = "chunks") -> str:
    return f"""{name}_t AS (SELECT *, {_tokens('text')} AS t FROM {source}),
{name} AS (
  SELECT format('{{}}::c{{:03d}}', article_id, i) AS chunk_id, author, config, split, article_id AS source_doc_id, CAST(i AS INTEGER) AS chunk_index,
    t[i * {size} + 1 : i * {size} + {size}] AS tokens, len(t[i * {size} + 1 : i * {size} + {size}]) AS n_tokens
  FROM (SELECT *, unnest(range(0, (len(t) + {size - 1}) // {size})) AS i FROM {name}_t) WHERE len(t[i * {size} + 1 : i * {size} + {size}]) >= {max(int(size * 0.8), 1)})"""


def _space(size: int, source: str = "articles") -> str:
    """Vocabulary, reference statistics and standardised chunks."""
    return f"""{ESSAYS}, {REFERENCE}, {_chunks(size, source)},
docs AS (SELECT chunk_id AS id, source_doc_id AS doc, author, chunk_index, {_words("array_to_string(tokens, ' ')")} AS w FROM chunks),
seen AS (SELECT doc, chunk_index, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM docs),
vocab AS (
  SELECT row_number() OVER (ORDER BY cnt DESC, first) - 1 AS idx, term, cnt
  FROM (SELECT term, count(*) AS cnt, min(g) AS first FROM (SELECT term, row_number() OVER (ORDER BY doc, chunk_index, place) AS g FROM seen) GROUP BY term ORDER BY cnt DESC, first LIMIT {WORDS})),
ref_docs AS (SELECT article_id AS id, {_words('text')} AS w FROM reference),
ref_rf AS (SELECT id, idx, count(*) / total AS rf FROM (SELECT id, unnest(w) AS term, len(w) AS total FROM ref_docs) JOIN vocab USING (term) GROUP BY id, idx, total),
ref_grid AS (SELECT idx, coalesce(rf, 0) AS rf FROM vocab CROSS JOIN (SELECT id FROM ref_docs) LEFT JOIN ref_rf USING (id, idx)),
stats AS (SELECT idx, avg(rf) AS mu, stddev_pop(rf) AS sigma FROM ref_grid GROUP BY idx),
rf AS (SELECT id, idx, count(*) / total AS rf FROM (SELECT id, unnest(w) AS term, len(w) AS total FROM docs) JOIN vocab USING (term) GROUP BY id, idx, total),
z AS (
  SELECT id, idx, (coalesce(rf, 0) - mu) / CASE WHEN sigma > 1e-12 THEN sigma ELSE 1 END AS z
  FROM (SELECT id, idx, mu, sigma FROM docs CROSS JOIN stats) LEFT JOIN rf USING (id, idx)),
vec AS (SELECT id, doc, author, list(z ORDER BY idx) AS vec FROM z JOIN docs USING (id) GROUP BY id, doc, author)"""


UNIT = "unit AS (SELECT id, doc, author, CASE WHEN sqrt(list_inner_product(vec, vec)) < 1e-12 THEN vec ELSE list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) END AS vec FROM vec)"
COSINE = "1 - greatest(-1, least(1, list_inner_product(a.vec, b.vec)))"
MANHATTAN = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: abs(p[1] - p[2])))"
EMBEDDINGS = "vec AS (SELECT format('{:08d}', vec_id) AS id, CAST(vec_id AS VARCHAR) AS doc, CAST(label AS VARCHAR) AS author, CAST(embedding AS DOUBLE[]) AS vec, vec_id FROM embeddings WHERE embedding IS NOT NULL)"
TWENTIETH = "CAST('0x' || substr(md5(a.id), 1, 8) AS BIGINT) % 20 = 0"


def _pairs(rows: str, d: str) -> str:
    return f"pairs AS (SELECT CAST(round(({d}) * 10000, 0) AS BIGINT) AS step, a.author = b.author AS same, a.id AS i, b.id AS j FROM {rows} a JOIN {rows} b ON a.id < b.id AND a.doc <> b.doc)"


AUC = """ranked AS (SELECT same, rank() OVER (ORDER BY step) + (count(*) OVER (PARTITION BY step) - 1) / 2 AS r FROM pairs)
SELECT count(*) AS n_pairs, CAST(count_if(same) AS BIGINT) AS n_self, CAST(count_if(NOT same) AS BIGINT) AS n_cross,
  round(1 - (sum(r) FILTER (same) - count_if(same) * (count_if(same) + 1) / 2) / (CAST(count_if(same) AS DOUBLE) * count_if(NOT same)), 6) AS auc FROM ranked"""


def _nearest(rows: str, d: str, where: str, places: int = 6) -> str:
    return f"""near AS (SELECT a.id AS query, b.id AS id, round({d}, {places}) AS distance FROM {rows} a JOIN {rows} b ON a.doc <> b.doc WHERE {where}),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, id) AS INTEGER) AS rank FROM near)
SELECT query, id, distance, rank FROM placed WHERE rank <= 10"""


PERMUTED = f"""named AS (SELECT id, author, row_number() OVER (ORDER BY id) AS ord FROM unit),
moved AS (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY md5('1729:' || k || ':' || id), id) AS ord FROM named CROSS JOIN range({PERMUTATIONS}) r(k)),
label AS (SELECT moved.id, k, named.author AS label FROM moved JOIN named ON moved.ord = named.ord),
ranked AS (SELECT i, j, rank() OVER (ORDER BY step) + (count(*) OVER (PARTITION BY step) - 1) / 2 AS r FROM pairs),
sums AS (
  SELECT a.k, count(*) AS n1, sum(r) AS s FROM ranked JOIN label a ON a.id = i JOIN label b ON b.id = j AND a.k = b.k AND a.label = b.label GROUP BY a.k),
permuted AS (SELECT CAST(k AS INTEGER) AS k, n1 AS n_self, 1 - (s - n1 * (n1 + 1) / 2) / (CAST(n1 AS DOUBLE) * ((SELECT count(*) FROM pairs) - n1)) AS auc FROM sums)"""

GRAMS = f"""{ESSAYS},
essay_words AS (SELECT article_id AS id, article_id AS doc, author, ' ' || unnest({_pieces('text')}) || ' ' AS p FROM articles),
grams AS (
  SELECT id, unnest(list_concat(list_transform(range(1, greatest(len(p) - 2, 1) + 1), lambda i: substr(p, i, 3)),
    CASE WHEN len(p) > 3 THEN list_transform(range(1, greatest(len(p) - 3, 1) + 1), lambda i: substr(p, i, 4)) ELSE [] END)) AS gram FROM essay_words),
tf AS (SELECT id, gram, count(*) AS tf FROM grams GROUP BY id, gram),
idf AS (SELECT gram, count(*) AS df, sum(tf) AS n, ln((1.0 + (SELECT count(*) FROM articles)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY gram HAVING count(*) >= 2),
raw AS (SELECT id, gram, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (gram)),
weights AS (SELECT id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""

GRAM_PAIRS = """gram_docs AS (SELECT DISTINCT id FROM weights),
dots AS (SELECT a.id AS i, b.id AS j, sum(a.w * b.w) AS dot FROM weights a JOIN weights b ON a.gram = b.gram AND a.id <> b.id GROUP BY a.id, b.id),
apart AS (SELECT a.id AS i, b.id AS j, 1 - greatest(-1, least(1, coalesce(dot, 0))) AS d FROM gram_docs a JOIN gram_docs b ON a.id <> b.id LEFT JOIN dots ON i = a.id AND j = b.id)"""

MATRIX = f"""distances AS (SELECT a.author AS x, b.author AS y, {COSINE} AS d FROM unit a JOIN unit b ON a.id <> b.id AND a.doc <> b.doc),
cells AS (SELECT x, y, count(*) AS n, avg(d) AS mean FROM distances GROUP BY x, y),
names AS (SELECT DISTINCT author FROM unit),
matrix AS (
  SELECT a.author AS author_i, b.author AS author_j, CASE WHEN a.author = b.author THEN coalesce(n, 0) // 2 ELSE coalesce(n, 0) END AS n_pairs, coalesce(mean, CAST('nan' AS DOUBLE)) AS mean_distance
  FROM names a CROSS JOIN names b LEFT JOIN cells ON x = a.author AND y = b.author)"""

MADE = f"""made AS (
  SELECT target_article_id, model_alias, body, rec_id FROM (
    SELECT coalesce(source_article_id, article_id) AS target_article_id, {_key('model_alias')} AS model_alias, body, rec_id,
      row_number() OVER (PARTITION BY coalesce(source_article_id, article_id), {_key('model_alias')} ORDER BY rec_id DESC) AS r
    FROM recreation WHERE {_norm('body')} <> '' AND coalesce(source_article_id, article_id) IS NOT NULL AND {_key('model_alias')} IS NOT NULL) WHERE r = 1)"""

FOLD_ROWS = f"""f AS (
  SELECT * EXCLUDE (r, author, model_alias, m), {_key('author')} AS author, m AS model_alias FROM (
    SELECT *, {_key('model_alias')} AS m, row_number() OVER (PARTITION BY {_key('model_alias')}, target_article_id ORDER BY fold DESC) AS r FROM fold_result
    WHERE {_key('model_alias')} IS NOT NULL AND target_article_id IS NOT NULL) WHERE r = 1),
v AS (SELECT * FROM f WHERE generated_n_chunks > 0 AND delta_natural_vs_generated IS NOT NULL AND NOT isnan(delta_natural_vs_generated)),
pool AS (SELECT target_article_id, natural_mean_distance FROM (SELECT *, row_number() OVER (PARTITION BY target_article_id ORDER BY model_alias DESC) AS q FROM f) WHERE q = 1),
scores AS (
  SELECT model_alias, generated_mean_distance AS score, true AS positive FROM v
  UNION ALL SELECT m.model_alias, natural_mean_distance, false FROM pool CROSS JOIN (SELECT DISTINCT model_alias FROM f) m),
steps AS (
  SELECT model_alias, round(score, 4) AS s, count_if(positive) AS p, count_if(NOT positive) AS n FROM scores WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
auc AS (
  SELECT model_alias, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg,
    CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN round(sum(p * (less + n / 2)) / (CAST(sum(p) AS DOUBLE) * sum(n)), 6) ELSE CAST('nan' AS DOUBLE) END AS auc
  FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY model_alias ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM steps) GROUP BY model_alias)"""


def _summary(group: str = "") -> str:
    nan = "CAST('nan' AS DOUBLE)"
    cols = []
    for name in ("natural", "generated", "delta"):
        x = f"coalesce({'delta_natural_vs_generated' if name == 'delta' else name + '_mean_distance'}, {nan})"
        bad = f"count_if(isnan({x})) > 0"
        ok = f"FILTER (NOT isnan({x}))"
        cols.append(f"CASE WHEN {bad} THEN {nan} ELSE round(avg({x}) {ok}, 6) END AS {name}_mean, CASE WHEN count(*) = 1 THEN 0 WHEN {bad} THEN {nan} ELSE round(coalesce(stddev_samp({x}) {ok}, 0), 6) END AS {name}_std")
    return f"WITH {FOLD_ROWS} SELECT {group + ', ' if group else ''}count(*) AS n_folds, {', '.join(cols)} FROM f {'GROUP BY ' + group if group else ''}"


def _ranking(match: bool) -> str:
    mean = "round(1 - avg(x), 6)" if match else "round(avg(x), 6)"
    return f"""WITH {FOLD_ROWS}, x AS (
  SELECT 'natural' AS label, natural_mean_distance AS x FROM pool WHERE natural_mean_distance IS NOT NULL AND NOT isnan(natural_mean_distance)
  UNION ALL SELECT model_alias, generated_mean_distance FROM v WHERE generated_mean_distance IS NOT NULL AND NOT isnan(generated_mean_distance)),
r AS (SELECT label, count(*) AS n, {mean} AS mean, round(coalesce(stddev_samp(x), 0), 6) AS std FROM x GROUP BY label)
SELECT label, n, mean, std, CAST(row_number() OVER (ORDER BY mean {'DESC' if match else ''}, label) AS INTEGER) AS place FROM r"""


def _tricks(group: str) -> str:
    return f"WITH {FOLD_ROWS} SELECT {group}, count(*) AS n_folds, CAST(count_if(delta_natural_vs_generated < 0) AS BIGINT) AS n_tricks, round(count_if(delta_natural_vs_generated < 0) / count(*), 6) AS trick_rate FROM v GROUP BY {group}"


def _report_cols(n: str, what: str) -> str:
    return f"CAST(sum({n}) AS BIGINT) AS total_{what}, CAST(min({n}) AS INTEGER) AS min_{what}, CAST(max({n}) AS INTEGER) AS max_{what}, round(avg({n}), 6) AS mean_{what}"


DETAILS = "det AS (SELECT article_id, model_slug, max(assignment) AS assignment FROM detail WHERE article_id IS NOT NULL AND assignment IS NOT NULL AND model_slug IS NOT NULL GROUP BY ALL)"
SAMPLED = f"sampled AS (SELECT author, article_id FROM (SELECT author, article_id, row_number() OVER (PARTITION BY author ORDER BY md5('1729:' || article_id), article_id) AS pick FROM articles) WHERE pick <= {SAMPLE})"


def _message(x: str) -> str:
    return f"{_estimate(f'len({_pieces(x)})')} + 4"


def _placed(name: str, column: str, order: str) -> str:
    nan = "CAST('nan' AS DOUBLE)"
    x = f"coalesce({column}, {nan})"
    return f"""WITH {FOLD_ROWS}, m AS (SELECT {name}, CASE WHEN count_if(isnan({x})) > 0 THEN {nan} ELSE round(avg({x}) FILTER (NOT isnan({x})), 6) END AS mean FROM f GROUP BY {name})
SELECT CAST(row_number() OVER (ORDER BY isnan(mean), mean {order}, {name}) AS INTEGER) AS place, {name}, mean FROM m"""


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"

SQL: dict[str, str] = {
    "text_normalized": f"SELECT doc_id, md5({_norm('text')}) AS norm_md5, CAST(length({_norm('text')}) AS INTEGER) AS n_chars_norm FROM documents",
    "text_counts": f"SELECT doc_id, CAST(len({_words('text')}) AS INTEGER) AS n_words, CAST(len({_tokens('text')}) AS INTEGER) AS n_tokens, CAST(len({_pieces('text')}) AS INTEGER) AS n_pieces, CAST({_estimate(f'len({_pieces("text")})')} AS INTEGER) AS model_tokens FROM documents",
    "test_articles": f"WITH {ESSAYS} SELECT article_id, author, config, split, topic, lang, md5(text) AS text_md5 FROM articles",
    "reference_articles": f"WITH {REFERENCE} SELECT article_id, author, config, split, md5(text) AS text_md5 FROM reference",
    "article_summary": f"WITH {BOTH} SELECT author, count(*) AS n_articles, {_report_cols(f'len({_pieces("text")})', 'words')} FROM both_slices GROUP BY author",
    "config_split_counts": f"WITH {BOTH} SELECT config, split, count(*) AS n_articles, count(DISTINCT author) AS n_authors FROM both_slices GROUP BY config, split",
    "reference_overlap": f"WITH {BOTH} SELECT article_id, author, md5({_norm('text')}) AS h FROM articles WHERE md5({_norm('text')}) IN (SELECT md5({_norm('text')}) FROM reference)",
    "text_extraction": f"""SELECT rec_id, md5(coalesce(nullif(body, ''), nullif(title, ''), nullif(article_id, ''))) AS text_md5, string_split(model_slug, '/')[-1] AS model,
  coalesce(nullif(trim(title, ' '), ''), nullif(trim(article_id, ' '), '')) AS title, coalesce(source_article_id, article_id) AS essay_id
  FROM (SELECT *, row_number() OVER (PARTITION BY rec_id) AS r FROM recreation) WHERE r = 1""",
    "prompt_tokens": f"""WITH {ESSAYS}, det AS (SELECT article_id, model_slug, max(assignment) AS assignment FROM detail WHERE assignment IS NOT NULL GROUP BY ALL),
rec AS (SELECT * FROM (SELECT article_id, model_slug, body, row_number() OVER (PARTITION BY article_id, model_slug ORDER BY rec_id DESC) AS r FROM recreation) WHERE r = 1),
ctx AS (SELECT article_id, sum(n) OVER (PARTITION BY author) - n AS others FROM (SELECT article_id, author, len({_pieces('text')}) AS n FROM articles))
SELECT model_slug, count(*) AS n, CAST(sum({_estimate(f'len({_pieces("assignment")})')} + 4 + {_estimate('others')} + 4) AS BIGINT) AS input_tokens, CAST(sum({_estimate(f'len({_pieces("body")})')}) AS BIGINT) AS output_tokens
FROM rec JOIN det USING (article_id, model_slug) JOIN ctx USING (article_id) GROUP BY model_slug""",
    "author_context": f"""WITH {ESSAYS}, n AS (SELECT article_id, author, len({_pieces('text')}) AS n FROM articles)
SELECT article_id, author, count(*) OVER (PARTITION BY author) - 1 AS n_others, CAST(sum(n) OVER (PARTITION BY author) - n AS BIGINT) AS words_others FROM n""",
    "chunks": f"WITH {ESSAYS}, {_chunks(CHUNK)} SELECT chunk_id, author, config, split, source_doc_id, chunk_index, CAST(n_tokens AS INTEGER) AS n_tokens, md5(array_to_string(tokens, ' ')) AS token_md5 FROM chunks",
    "chunk_report": f"WITH {ESSAYS}, {_chunks(CHUNK)} SELECT author, count(*) AS n_chunks, {_report_cols('n_tokens', 'tokens')}, count(DISTINCT source_doc_id) AS n_source_docs FROM chunks GROUP BY author",
    "stored_chunk_report": f"""WITH c AS (SELECT chunk_id, min({_key('author')}) AS author, min(source_doc_id) AS source_doc_id, max(len(tokens)) AS n_tokens FROM chunk WHERE chunk_id IS NOT NULL GROUP BY chunk_id)
SELECT author, count(*) AS n_chunks, {_report_cols('n_tokens', 'tokens')}, count(DISTINCT source_doc_id) AS n_source_docs FROM c GROUP BY author""",
    "few_chunks": f"WITH {ESSAYS}, {_chunks(CHUNK)} SELECT author, count(*) AS n_chunks FROM chunks GROUP BY author HAVING count(*) < {FEWEST_CHUNKS}",
    "mfw_vocabulary": f"WITH {_space(CHUNK)} SELECT CAST(idx AS INTEGER) AS idx, term, cnt FROM vocab",
    "mfw_head": f"WITH {_space(CHUNK)} SELECT CAST(idx AS INTEGER) AS idx, term, cnt FROM vocab WHERE idx < 50",
    "mfw_frequencies": f"WITH {_space(CHUNK)} SELECT id, CAST(idx AS INTEGER) AS idx, round(rf, 9) AS rf FROM rf",
    "mfw_reference_stats": f"WITH {_space(CHUNK)} SELECT CAST(idx AS INTEGER) AS idx, term, round(mu, 9) AS mu, round(sigma, 9) AS sigma FROM stats JOIN vocab USING (idx)",
    "mfw_zscores": f"WITH {_space(CHUNK)} SELECT id, CAST(idx AS INTEGER) AS idx, round(z, 6) AS z FROM z",
    "char_gram_idf": f"WITH {GRAMS} SELECT gram, df, round(idf, 9) AS idf FROM idf",
    "char_gram_weights": f"WITH {GRAMS} SELECT id, gram, round(w, 9) AS w FROM weights",
    "char_gram_top": f"WITH {GRAMS} SELECT gram, df FROM idf ORDER BY n DESC, gram LIMIT 500",
    "content_words": f"""WITH {ESSAYS}, w AS (SELECT author, unnest({_words('text')}) AS word FROM articles)
SELECT author, count(*) AS n_content, count(DISTINCT word) AS n_different FROM w WHERE regexp_full_match(word, '\\p{{L}}+') AND NOT list_contains({_STOP}, word) GROUP BY author""",
    "leakage_idf": f"""WITH {ESSAYS}, w AS (SELECT DISTINCT article_id, unnest({_words('text', WORD2)}) AS word FROM articles)
SELECT word, count(*) AS df, round(ln((1.0 + (SELECT count(*) FROM articles)) / (1.0 + count(*))) + 1, 9) AS idf FROM w GROUP BY word HAVING count(*) >= 2""",
    "leakage_folds": f"WITH {ESSAYS} SELECT article_id AS id, author, CAST((row_number() OVER (PARTITION BY author ORDER BY md5('1729:' || article_id), article_id) - 1) % {FOLDS} AS INTEGER) AS fold FROM articles",
    "cosine_delta_nearest": f"WITH {_space(CHUNK)}, {UNIT}, {_nearest('unit', COSINE, TWENTIETH)}",
    "burrows_delta_nearest": f"WITH {_space(CHUNK)}, {_nearest('vec', MANHATTAN, TWENTIETH, 5)}",
    "char_gram_nearest": f"""WITH {GRAMS}, {GRAM_PAIRS},
near AS (SELECT i AS query, j AS id, round(d, 6) AS distance FROM apart),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, id) AS INTEGER) AS rank FROM near) SELECT query, id, distance, rank FROM placed WHERE rank <= 10""",
    "embedding_cosine_nearest": f"WITH {EMBEDDINGS}, {UNIT}, {_nearest('unit', COSINE, 'CAST(a.id AS BIGINT) % 20 = 0')}",
    "embedding_l1_nearest": f"WITH {EMBEDDINGS}, {_nearest('vec', MANHATTAN, 'a.vec_id % 20 = 0')}",
    "auc_cosine_delta": f"WITH {_space(CHUNK)}, {UNIT}, {_pairs('unit', COSINE)}, {AUC}",
    "auc_burrows_delta": f"WITH {_space(CHUNK)}, {_pairs('vec', f"least(({MANHATTAN}) / len(a.vec), 100)")}, {AUC}",
    "auc_char_gram": f"WITH {GRAMS}, {GRAM_PAIRS}, pairs AS (SELECT CAST(round(d * 10000, 0) AS BIGINT) AS step, a.author = b.author AS same FROM apart JOIN articles a ON a.article_id = i JOIN articles b ON b.article_id = j WHERE i < j), {AUC}",
    "auc_embedding": f"WITH {EMBEDDINGS}, {UNIT}, {_pairs('unit', COSINE)}, {AUC}",
    "permutation_auc": f"WITH {_space(CHUNK)}, {UNIT}, {_pairs('unit', COSINE)}, {PERMUTED} SELECT k, n_self, round(auc, 6) AS auc FROM permuted",
    "permutation_summary": f"""WITH {_space(CHUNK)}, {UNIT}, {_pairs('unit', COSINE)}, {PERMUTED},
observed AS (SELECT 1 - (sum(r) - count(*) * (count(*) + 1) / 2) / (CAST(count(*) AS DOUBLE) * ((SELECT count(*) FROM pairs) - count(*))) AS auc FROM ranked JOIN pairs USING (i, j) WHERE same),
x AS (SELECT count(*) AS n_valid, avg(auc) AS mean, coalesce(stddev_samp(auc), 0) AS std, median(auc) AS median, quantile_cont(auc, 0.95) AS q95, quantile_cont(auc, 0.99) AS q99, CAST(count_if(auc >= (SELECT auc FROM observed)) AS BIGINT) AS n_at_least FROM permuted)
SELECT n_valid, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, round(q95, 6) AS q95, round(q99, 6) AS q99, n_at_least, round((1 + n_at_least) / (1 + n_valid), 6) AS p_value FROM x""",
    "distance_histogram": f"""WITH {_space(CHUNK)}, {UNIT}, {_pairs('unit', COSINE)},
e AS (SELECT same, step, min(step) OVER (PARTITION BY same) AS lo, max(step) OVER (PARTITION BY same) AS hi FROM pairs)
SELECT CAST(same AS INTEGER) AS is_self, CAST(CASE WHEN hi > lo THEN least(29, floor((step - lo) * 30 / (hi - lo))) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM e GROUP BY 1, 2""",
    "author_distances": f"WITH {_space(CHUNK)}, {UNIT}, {MATRIX} SELECT author_i, author_j, n_pairs, round(mean_distance, 6) AS mean_distance FROM matrix",
    "author_similarity_raw": f"WITH {_space(CHUNK)}, {UNIT}, {MATRIX} SELECT author_i, author_j, CASE WHEN isnan(mean_distance) THEN mean_distance ELSE round(greatest(0, least(1, 1 - mean_distance)), 6) END AS similarity FROM matrix",
    "author_similarity_normalized": f"""WITH {_space(CHUNK)}, {UNIT}, {MATRIX}, ends AS (SELECT min(1 - mean_distance) AS lo, max(1 - mean_distance) AS hi FROM matrix WHERE NOT isnan(mean_distance))
SELECT author_i, author_j, CASE WHEN isnan(mean_distance) THEN mean_distance WHEN hi > lo THEN round((1 - mean_distance - lo) / (hi - lo), 6) ELSE 0 END AS similarity FROM matrix CROSS JOIN ends""",
    "essay_sample": f"WITH {ESSAYS}, r AS (SELECT author, article_id, CAST(row_number() OVER (PARTITION BY author ORDER BY md5('1729:' || article_id), article_id) AS INTEGER) AS pick FROM articles) SELECT * FROM r WHERE pick <= 5",
    "essay_manifest": f"WITH {ESSAYS} SELECT author, article_id, CAST(len({_tokens('text')}) AS INTEGER) AS tokens FROM articles",
    "leave_one_out": f"""WITH {ESSAYS}, {MADE}, t AS (SELECT author, article_id FROM articles WHERE article_id IN (SELECT target_article_id FROM made))
SELECT row_number() OVER (ORDER BY author, article_id) - 1 AS fold, author, article_id AS target_article_id, count(*) OVER (PARTITION BY author) - 1 AS corpus_articles FROM t""",
    "detail_upsert": "SELECT article_id, model_slug, md5(max(assignment)) AS assignment_md5 FROM detail WHERE article_id IS NOT NULL AND assignment IS NOT NULL GROUP BY ALL",
    "usable_recreations": f"WITH {MADE} SELECT target_article_id, model_alias, rec_id, target_article_id || '::gen' AS gen_id, md5(body) AS body_md5 FROM made",
    "missing_recreations": f"WITH {ESSAYS}, {MADE} SELECT article_id AS target_article_id, author FROM articles WHERE article_id NOT IN (SELECT target_article_id FROM made)",
    "known_models": f"SELECT DISTINCT {_key('r.model_alias')} AS model_alias, m.model_slug FROM recreation r JOIN model_map m ON {_key('r.model_alias')} = {_key('m.model_alias')}",
    "fold_scores": f"""WITH {MADE}, {_space(FOLD_CHUNK, "(SELECT a.* FROM articles a WHERE article_id IN (SELECT target_article_id FROM made))")}, {UNIT},
answers AS (SELECT author, model_alias AS config, 'generated' AS split, target_article_id || '|' || model_alias AS article_id, body AS text FROM made JOIN articles ON article_id = target_article_id),
{_chunks(FOLD_CHUNK, 'answers', 'gen')},
gw AS (SELECT chunk_id AS id, source_doc_id AS doc, {_words("array_to_string(tokens, ' ')")} AS w FROM gen),
grf AS (SELECT id, idx, count(*) / total AS rf FROM (SELECT id, unnest(w) AS term, len(w) AS total FROM gw) JOIN vocab USING (term) GROUP BY id, idx, total),
gz AS (SELECT id, doc, idx, (coalesce(rf, 0) - mu) / CASE WHEN sigma > 1e-12 THEN sigma ELSE 1 END AS z FROM (SELECT id, doc, idx, mu, sigma FROM gw CROSS JOIN stats) LEFT JOIN grf USING (id, idx)),
gvec AS (SELECT id, doc, list(z ORDER BY idx) AS vec FROM gz GROUP BY id, doc),
gunit AS (SELECT id, doc, CASE WHEN sqrt(list_inner_product(vec, vec)) < 1e-12 THEN vec ELSE list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) END AS vec FROM gvec),
base AS (SELECT author, target_article_id, model_alias, target_article_id || '|' || model_alias AS g FROM made JOIN articles ON article_id = target_article_id),
per AS (SELECT author, doc, count(*) AS n FROM unit GROUP BY author, doc),
nat AS (SELECT a.doc AS t, avg({COSINE}) AS d FROM unit a JOIN unit b ON a.author = b.author AND a.doc <> b.doc GROUP BY a.doc),
genm AS (SELECT g, avg({COSINE}) AS d FROM base JOIN gunit a ON a.doc = g JOIN unit b ON b.author = base.author AND b.doc <> target_article_id GROUP BY g),
gn AS (SELECT doc, count(*) AS n FROM gunit GROUP BY doc)
SELECT base.author, base.target_article_id, base.model_alias, coalesce(per.n, 0) AS natural_n_chunks, coalesce(gn.n, 0) AS generated_n_chunks,
  CAST(coalesce((SELECT sum(n) FROM per p WHERE p.author = base.author), 0) - coalesce(per.n, 0) AS BIGINT) AS corpus_n_chunks,
  coalesce(round(nat.d, 6), CAST('nan' AS DOUBLE)) AS natural_mean_distance, coalesce(round(genm.d, 6), CAST('nan' AS DOUBLE)) AS generated_mean_distance,
  coalesce(round(genm.d - nat.d, 6), CAST('nan' AS DOUBLE)) AS delta_natural_vs_generated
FROM base LEFT JOIN per ON per.doc = target_article_id LEFT JOIN gn ON gn.doc = g LEFT JOIN nat ON t = target_article_id LEFT JOIN genm ON genm.g = base.g""",
    "kept_dropped_folds": f"WITH {FOLD_ROWS} SELECT model_alias, count(v.target_article_id) AS kept, count(*) - count(v.target_article_id) AS dropped FROM f LEFT JOIN v USING (model_alias, target_article_id) GROUP BY model_alias",
    "fold_summary": _summary(),
    "fold_summary_model": _summary("model_alias"),
    "fold_summary_author": _summary("model_alias, author"),
    "natural_pool": f"WITH {FOLD_ROWS} SELECT target_article_id, natural_mean_distance FROM pool",
    "ranking_distance": _ranking(False),
    "ranking_match": _ranking(True),
    "author_breakdown": f"""WITH {FOLD_ROWS}, m AS (SELECT author, model_alias, round(avg(delta_natural_vs_generated), 6) AS d FROM v GROUP BY ALL)
SELECT author, max(d) FILTER (model_alias = 'inkwell-mini') AS "inkwell-mini", max(d) FILTER (model_alias = 'marlow-70b') AS "marlow-70b", max(d) FILTER (model_alias = 'quill-3.1') AS "quill-3.1", max(d) FILTER (model_alias = 'tessera-2') AS "tessera-2" FROM m GROUP BY author""",
    "tricks_by_model": f"""WITH {FOLD_ROWS}, x AS (SELECT *, delta_natural_vs_generated AS d FROM v)
SELECT coalesce(model_alias, 'all_models_pooled') AS model_alias, count(*) AS n_folds, CAST(count_if(d < 0) AS BIGINT) AS n_tricks, round(count_if(d < 0) / count(*), 6) AS trick_rate, round(avg(d), 6) AS mean_delta, round(median(d), 6) AS median_delta,
  first(target_article_id ORDER BY d, target_article_id) FILTER (d < 0) AS best_trick FROM x GROUP BY ROLLUP (model_alias)""",
    "tricks_by_author": _tricks("author"),
    "tricks_by_model_author": _tricks("model_alias, author"),
    "trick_matrix": f"""WITH {FOLD_ROWS}, x AS (SELECT f.target_article_id, f.model_alias, coalesce(v.delta_natural_vs_generated < 0, false) AS trick FROM f LEFT JOIN v USING (model_alias, target_article_id))
SELECT target_article_id, coalesce(string_agg(model_alias, ',' ORDER BY model_alias) FILTER (trick), '') AS models_tricked, count(*) FILTER (trick) AS n_models FROM x GROUP BY target_article_id""",
    "jaccard": f"""WITH {FOLD_ROWS}, s AS (SELECT model_alias, target_article_id FROM v WHERE delta_natural_vs_generated < 0), names AS (SELECT DISTINCT {_key('model_alias')} AS m FROM model_map),
g AS (SELECT a.m AS model_a, b.m AS model_b, (SELECT count(*) FROM s x JOIN s y ON x.target_article_id = y.target_article_id WHERE x.model_alias = a.m AND y.model_alias = b.m) AS c,
  (SELECT count(*) FROM s WHERE model_alias = a.m) AS na, (SELECT count(*) FROM s WHERE model_alias = b.m) AS nb FROM names a CROSS JOIN names b)
SELECT model_a, model_b, c AS both, na + nb - c AS either, CASE WHEN na + nb - c > 0 THEN round(c / (na + nb - c), 6) ELSE 0 END AS jaccard FROM g""",
    "detection_auc": f"WITH {FOLD_ROWS} SELECT model_alias, n_pos, n_neg, auc FROM auc",
    "detection_roc": f"""WITH {FOLD_ROWS} SELECT model_alias, s AS threshold, round(sum(p) OVER w / sum(p) OVER a, 6) AS tpr, round(sum(n) OVER w / sum(n) OVER a, 6) AS fpr FROM steps
WINDOW w AS (PARTITION BY model_alias ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY model_alias)""",
    "delta_quartiles": f"""WITH {FOLD_ROWS}, x AS (SELECT model_alias, delta_natural_vs_generated AS d FROM v)
SELECT model_alias, min(d) AS least, round(quantile_cont(d, 0.25), 6) AS q1, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75), 6) AS q3, max(d) AS most FROM x GROUP BY model_alias""",
    "headline": f"""WITH {FOLD_ROWS}, m AS (SELECT model_alias AS k, round(avg(generated_mean_distance), 6) AS v FROM v GROUP BY 1), a AS (SELECT author AS k, round(avg(delta_natural_vs_generated), 6) AS v FROM v GROUP BY 1),
x AS (SELECT model_alias AS k, auc AS v FROM auc WHERE NOT isnan(auc))
SELECT 'best_mimic' AS pick, (SELECT k FROM m ORDER BY v, k LIMIT 1) AS name UNION ALL SELECT 'best_detected', (SELECT k FROM x ORDER BY v DESC, k LIMIT 1)
UNION ALL SELECT 'hardest_author', (SELECT k FROM a ORDER BY v, k LIMIT 1) UNION ALL SELECT 'easiest_author', (SELECT k FROM a ORDER BY v DESC, k LIMIT 1)""",
    "detail_tokens": f"""WITH {ESSAYS}, {DETAILS} SELECT author, count(*) AS n, CAST(sum({_message('text')}) AS BIGINT) AS input_tokens, CAST(sum({_estimate(f'len({_pieces("assignment")})')}) AS BIGINT) AS output_tokens
FROM det JOIN articles USING (article_id) GROUP BY author""",
    "recreation_tokens": f"""WITH {ESSAYS}, {DETAILS}, rec AS (SELECT * FROM (SELECT article_id, model_slug, body, row_number() OVER (PARTITION BY article_id, model_slug ORDER BY rec_id DESC) AS r FROM recreation) WHERE r = 1)
SELECT author, model_slug, count(*) AS n, CAST(sum({_message('assignment')}) AS BIGINT) AS input_tokens, CAST(sum({_estimate(f'len({_pieces("body")})')}) AS BIGINT) AS output_tokens
FROM rec JOIN det USING (article_id, model_slug) JOIN articles USING (article_id) GROUP BY author, model_slug""",
    "recreation_prompts": f"""WITH {ESSAYS}, {DETAILS}, {SAMPLED},
others AS (SELECT a.article_id, string_agg('--- ' || b.article_id || ' ---' || chr(10) || t.text, chr(10) || chr(10) ORDER BY b.article_id) AS context
  FROM sampled a JOIN sampled b ON a.author = b.author AND a.article_id <> b.article_id JOIN articles t ON t.article_id = b.article_id GROUP BY a.article_id),
p AS (SELECT article_id, model_slug, coalesce(context, '(No other essays are at hand.)') || chr(10) || chr(10) || assignment AS prompt FROM det JOIN sampled USING (article_id) LEFT JOIN others USING (article_id))
SELECT article_id, model_slug, md5(prompt) AS prompt_md5, CAST({_message('prompt')} AS INTEGER) AS tokens FROM p""",
    "model_aliases": f"""WITH m AS (SELECT {_key('model_alias')} AS model_alias, min(model_slug) AS model_slug FROM model_map WHERE {_key('model_alias')} IS NOT NULL GROUP BY 1)
SELECT DISTINCT a.model_alias, m.model_slug, m.model_alias IS NOT NULL AS known FROM (SELECT {_key('model_alias')} AS model_alias FROM recreation) a LEFT JOIN m ON a.model_alias = m.model_alias WHERE a.model_alias IS NOT NULL""",
    "uneven_authors": f"WITH {ESSAYS}, {SAMPLED} SELECT author, count(*) AS n FROM sampled GROUP BY author HAVING count(*) <> {SAMPLE}",
    "detail_resume": f"""WITH {ESSAYS}, {DETAILS}, placed AS (SELECT article_id, row_number() OVER (ORDER BY author, article_id) AS place FROM articles)
SELECT place, article_id, m.model_slug AS model, md5(assignment) AS assignment_md5, assignment IS NULL AS todo FROM placed CROSS JOIN (SELECT DISTINCT model_slug FROM model_map WHERE model_slug IS NOT NULL) m LEFT JOIN det USING (article_id, model_slug)""",
    "article_ids": """WITH r AS (SELECT DISTINCT config, split, author, md5(coalesce(text, '')) AS h FROM essays WHERE article_id IS NULL OR trim(article_id, ' ') IN ('', '0')),
n AS (SELECT *, row_number() OVER (PARTITION BY config, split, author ORDER BY h) - 1 AS n FROM r)
SELECT concat_ws('/', n.config, n.split, n.author, CAST(n.n AS VARCHAR)) AS article_id, md5(e.text) AS text_md5 FROM essays e JOIN n ON e.config IS NOT DISTINCT FROM n.config AND e.split IS NOT DISTINCT FROM n.split AND e.author IS NOT DISTINCT FROM n.author AND md5(coalesce(e.text, '')) = n.h
WHERE e.article_id IS NULL OR trim(e.article_id, ' ') IN ('', '0')""",
    "trick_grid": f"""WITH {FOLD_ROWS} SELECT t.target_article_id, m.model_alias, CAST(coalesce(v.delta_natural_vs_generated < 0, false) AS INTEGER) AS trick
FROM (SELECT DISTINCT target_article_id FROM f) t CROSS JOIN (SELECT DISTINCT {_key('model_alias')} AS model_alias FROM model_map WHERE {_key('model_alias')} IS NOT NULL) m LEFT JOIN v USING (target_article_id, model_alias)""",
    "chunk_drift": f"""WITH {_space(CHUNK)}, p AS (SELECT vec.id, vec.doc, vec.vec, chunk_index FROM vec JOIN docs USING (id))
SELECT a.id, round(CASE WHEN sqrt(list_inner_product(a.vec, a.vec)) < 1e-12 OR sqrt(list_inner_product(b.vec, b.vec)) < 1e-12 THEN 0 ELSE 1 - list_inner_product(a.vec, b.vec) / (sqrt(list_inner_product(a.vec, a.vec)) * sqrt(list_inner_product(b.vec, b.vec))) END, 6) AS distance
FROM p a JOIN p b ON a.doc = b.doc AND a.chunk_index = b.chunk_index + 1""",
    "author_heatmap": f"""WITH {FOLD_ROWS} SELECT author, model_alias, count(*) AS n_folds, round(avg(natural_mean_distance), 6) AS natural, round(avg(generated_mean_distance), 6) AS generated, round(avg(delta_natural_vs_generated), 6) AS delta FROM v GROUP BY ALL""",
    "author_order": _placed("author", "natural_mean_distance", "DESC"),
    "model_order": _placed("model_alias", "delta_natural_vs_generated", "ASC"),
    "author_distances_burrows": f"""WITH {_space(CHUNK)}, distances AS (SELECT a.author AS x, b.author AS y, {MANHATTAN} AS d FROM vec a JOIN vec b ON a.id <> b.id AND a.doc <> b.doc)
SELECT x AS author_i, y AS author_j, CASE WHEN x = y THEN count(*) // 2 ELSE count(*) END AS n_pairs, round(avg(d), 5) AS mean_distance FROM distances GROUP BY x, y""",
    "author_distances_char_gram": f"""WITH {GRAMS}, {GRAM_PAIRS}
SELECT a.author AS author_i, b.author AS author_j, CASE WHEN a.author = b.author THEN count(*) // 2 ELSE count(*) END AS n_pairs, round(avg(d), 6) AS mean_distance FROM apart JOIN articles a ON a.article_id = i JOIN articles b ON b.article_id = j GROUP BY 1, 2""",
    "fold_corpus": f"WITH {ESSAYS}, {SAMPLED} SELECT a.author, a.article_id AS target_article_id, b.article_id AS corpus_article_id FROM sampled a JOIN sampled b ON a.author = b.author AND a.article_id <> b.article_id",
    "largest_authors": f"WITH {ESSAYS} SELECT article_id, author FROM articles WHERE author IN (SELECT author FROM articles GROUP BY author ORDER BY count(*) DESC, author LIMIT 3)",
    "char_gram_names": f"WITH {GRAMS} SELECT row_number() OVER (ORDER BY gram) - 1 AS idx, gram FROM idf",
}
